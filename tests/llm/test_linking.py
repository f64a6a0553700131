"""Classes of linked members of buckets against all pairs."""

import random

from pyspark.sql import functions as F

from lorekeep.llm import linking

from .test_near_dup import roots


def found(spark, members, links, close=None):
    """members: bucket -> ids. id -> root of what links_in_buckets connects."""
    rows = spark.createDataFrame([(b, i, i) for b, ids in members.items() for i in ids], "bucket long, id long, hint long")
    known = F.broadcast(spark.createDataFrame([(min(p), max(p)) for p in links], "a long, b long").distinct())
    tested = []

    def verifier(ids):
        def verify(pairs):
            tested.append(pairs.count())
            return pairs.join(known, ["a", "b"], "left_semi")

        return verify

    rows = rows if close else rows.drop("hint")
    got = linking.components(linking.links_in_buckets(rows, verifier, close=close))
    return {r.id: r.root for r in got.collect()}, sum(tested)


def test_random_graphs(spark):
    """Buckets of 2 to 500 nodes, some over the same nodes, with few and with many links."""
    r = random.Random(9)
    members, links, at = {}, [], 0
    for b, n in enumerate((2, 3, 8, 9, 10, 24, 25, 40, 120, 500)):
        ids = list(range(at, at + n))
        at += n
        members[2 * b] = ids
        members[2 * b + 1] = r.sample(ids, max(1, n // 2)) + r.sample(range(at), min(at, 3))
        for _ in range(r.choice([n // 3, n, n * n // 4])):
            links.append(tuple(r.sample(ids, 2)))
    members = {b: set(ids) for b, ids in members.items()}
    links = {(min(p), max(p)) for p in links}
    want = roots(range(at), [p for p in links if any(set(p) <= ids for ids in members.values())])
    got, _ = found(spark, members, links)
    assert {i: got.get(i, i) for i in range(at)} == want


def test_member_that_resembles_a_linked_one_only(spark):
    links = {(28, 29)} | {(i, 28) for i in range(28)}
    got, _ = found(spark, {0: range(30)}, links)
    assert got == dict.fromkeys(range(30), 0)


def test_alike_members_cost_few_pairs(spark):
    n = 24
    for n in (24, 25):
        got, tested = found(spark, {b: range(n) for b in range(20)}, {(a, b) for a in range(n) for b in range(a)})
        assert got == dict.fromkeys(range(n), 0) and tested == n - 1


def test_hub_of_unlike_copies(spark):
    """A bucket of thousands, each linked to one node only, and one of groups linked to nothing else, of which close knows."""
    hub, n = 1717, 4000
    rows = spark.range(n).select("id", F.when(F.col("id") < 3000, 0).otherwise(1).cast("long").alias("bucket"), (F.col("id") % 100).alias("hint"))
    linked = (F.col("a") == hub) | (F.col("b") == hub) | (F.col("a") >= 3000) & (F.col("a") % 100 == F.col("b") % 100)
    inside = (F.col("b") < 3000) | (F.col("a") >= 3000)
    links = linking.links_in_buckets(rows.drop("hint"), lambda ids: lambda pairs: pairs.where(linked & inside))
    assert {r.id: r.root for r in linking.components(links).collect()} == {i: 0 if i < 3000 else 3000 + i % 100 for i in range(n)}
    rows = rows.where("bucket = 1")
    links = linking.links_in_buckets(rows, lambda ids: lambda pairs: pairs.where(linked), close=lambda x, y, once: (x == y) & once)
    assert {r.id: r.root for r in linking.components(links).collect()} == {i: 3000 + i % 100 for i in range(3000, n)}


def test_hints_of_nodes(spark):
    """The same classes where hints of the nodes tell pairs apart, and each pair is tested in one bucket."""
    r = random.Random(3)
    n = 300
    members = {b: set(r.sample(range(n), 120)) for b in range(12)}
    links = {(min(p), max(p)) for p in (r.sample(range(n), 2) for _ in range(400))} | {(min(7, i), max(7, i)) for i in range(0, n, 3) if i != 7}
    links = {p for p in links if (p[0] + p[1]) % 5}
    rows = spark.createDataFrame([(b, i) for b, ids in members.items() for i in ids], "bucket long, id long")
    known = F.broadcast(spark.createDataFrame(list(links), "a long, b long"))
    hints = spark.range(n).select("id", F.struct(F.col("id").alias("k")).alias("hint"))
    tested = []

    def verify(pairs):
        tested.append(pairs.count())
        return pairs.join(known, ["a", "b"], "left_semi")

    def close(x, y, once):
        return ((x["k"] + y["k"]) % 5 != 0) & once

    found = linking.links_in_buckets(rows, lambda ids: verify, close, lambda ids: (ids.join(hints, "id"), None))
    got = {x.id: x.root for x in linking.components(found).collect()}
    want = roots(range(n), [p for p in links if any(set(p) <= ids for ids in members.values())])
    assert {i: got.get(i, i) for i in range(n)} == want
    assert sum(tested[1:]) <= n * n / 2


def test_components_of_few_and_of_many_links(spark, monkeypatch):
    """The same on the driver and by joins, also where new links come on top of known components."""
    r = random.Random(5)
    links = [tuple(r.sample(range(400), 2)) for _ in range(300)]
    want = roots({i for p in links for i in p}, links)
    for most in (0, linking.EDGES):
        monkeypatch.setattr(linking, "EDGES", most)
        known = None
        for part in (links[:100], links[100:100], links[100:220], links[220:]):
            known = linking.joined(known, spark.createDataFrame([(min(p), max(p)) for p in part], "a long, b long"))
        got = [(x.id, x.root) for x in known.collect()]
        assert len(got) == len(want) and dict(got) == want


def test_places_of_a_node_leave_together(spark):
    """A bucket in which nodes have many hints is done as soon as one in which they have one."""
    rows = spark.range(40).select((F.col("id") % 4).alias("id"), F.lit(0).cast("long").alias("bucket"), F.struct(F.col("id").alias("k")).alias("hint"))
    rounds = []

    def verify(pairs):
        rounds.append(pairs.count())
        return pairs.where("false")

    found = linking.links_in_buckets(rows, lambda ids: verify, close=lambda x, y, once: F.lit(True))
    assert not found.count() and rounds[0] and len([n for n in rounds if n]) <= 2


def test_finished_buckets_leave_before_places_are_dealt_out(spark, monkeypatch):
    """Of buckets whose members are of one component no place is looked at again, and places with hints are not gathered
    before the buckets that are enough are known."""
    rows = spark.createDataFrame([(b, b % 100 * 5 + i, (0,)) for b in range(300) for i in range(5)], "bucket long, id long, hint struct<k: int>")
    places, gathered = [], []
    real, real_cut = linking.without, linking.cut

    def without(here, chosen):
        places.append(here.count())
        return real(here, chosen)

    def cut(df):
        out = real_cut(df)
        gathered.append((df.columns, linking.counted(out)))
        return out

    monkeypatch.setattr(linking, "without", without)
    monkeypatch.setattr(linking, "cut", cut)
    alike = lambda ids: lambda pairs: pairs.where("a div 5 = b div 5")
    got = linking.components(linking.links_in_buckets(rows, alike, close=lambda x, y, once: F.lit(True)))
    assert {r.id: r.root for r in got.collect()} == {i: i - i % 5 for i in range(500)}
    assert places == [0]
    # 300 buckets, of which 100 are enough
    assert max(n for columns, n in gathered if "hint" in columns) == 500


def test_an_id_meets_its_root_once(spark):
    """Where hints are of ids, what is known of an id is no row more for each of its places, and no place is lost; with
    hints of places the same is joined."""
    places = [(b, i) for i in range(50) for b in range(30)]
    rest = spark.createDataFrame(places, "bucket long, id long")
    known = linking.cut(spark.range(0, 50, 2).select("id", (F.col("id") % 10).alias("root"), F.col("id").alias("degree")))
    want = sorted((b, i, i if i % 2 else i % 10, 0 if i % 2 else i) for b, i in places)
    for hint, joins in ((F.lit(None).cast("int"), 0), (F.struct(F.col("id").alias("k")), 1)):
        x = linking.with_roots(rest.withColumn("hint", hint), known)
        assert x._jdf.queryExecution().optimizedPlan().toString().count("Join") == joins
        assert sorted(map(tuple, x.drop("hint").collect())) == want
