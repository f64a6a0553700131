"""Links and components for the near-duplicate operators. DataFrame functions only.

links_in_buckets: nodes fall into buckets, and those that share one may be linked. It returns links with the same
components as those of all pairs that share a bucket, for buckets of any size. A bucket works in rounds. In each,
representatives are tested against the members whose component is another one, and leave the bucket, for they have met
everybody. Members that are linked stay for the others. The bucket is done when its members are of one component.

- Round 0 takes one representative, the same for buckets of nearly the same members.
- Later rounds take 16, 256, 4096, those with most links first, which finds the original of many copies.
- A bucket with few members outside its largest component takes these, and is done.

Members that are alike cost a few tests each. Only a bucket of unlike members costs all its pairs, less those that the
operator's bound `close` tells apart without a look at their texts. A round's pairs are rows that are spread over all
tasks; no bucket is collected into one.

components: union-find by alternating large-star and small-star steps, each a join and a partial aggregation. After a
round only its new links are looked at, between the components known before. Up to EDGES links, which were counted, are
joined on the driver by the same rule, for the steps' many small jobs cost more than the links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .common import counted, cut, few_parts, release, small

#: So many members outside the largest component are few; the most representatives of a bucket in a round.
FEW, MOST = 64, 4096
#: So many 64-bit keys are broadcast at most, 3 MB; of buckets with several rows, once, 16 MB.
KEYS, SHARED = 100_000, 500_000
#: So many places of representatives with hints, of about 1 KB, are broadcast at most.
PLACES = 30_000
#: Edges to a partition of the union-find; so many links are joined on the driver at most, 2 MB.
SHARE, EDGES = 20_000, 100_000

#: Two hints, and whether no other bucket tests the pair -> whether to test it.
Close = Callable[[Column, Column, Column], Column]


def links_in_buckets(
    rows: DataFrame,
    verifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
    close: Close | None = None,
    hinter: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None,
    few: int = FEW,
    after: Callable[[], None] | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """Links (a, b), a < b, that connect what the verified pairs of all buckets connect.

    rows: id long, bucket long, and hint if close is given without hinter; a row for each place of a node in a bucket.
    verifier: the ids that may come up, once each -> a function from pairs (a, b), a < b, to those that are linked.
    close: two hints, and a condition that holds in one bucket of a pair alone (true where hints are of places) -> false
    only if the condition is, or if the pair would not be linked.
    hinter: the ids of buckets that are open after the first round -> id, hint, where hints belong to the node; and pairs
    (a, b) of them to be tested whatever close says, if any.
    after: called when rows are not read any more. The caller holds on to no frame they come from.
    known: links (cut) that need no test. They are among those returned, and members that they connect are not tested.
    """
    spark = rows.sparkSession
    if "hint" in rows.columns:
        shared = rows  # places with hints are wide, and are dealt out once, when the buckets that are enough are known
    else:
        # counted first without more of a member than its bucket, as most have one alone
        shared = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"))
        release(spark)
        shared = few_parts(cut(rows.join(small(shared, SHARED), "bucket", "left_semi")))
        release(spark)
    members = F.xxhash64(*[c for c in rows.columns if c != "bucket"])
    sizes = shared.select("bucket", "id", members.alias("m")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("id").alias("a"),
        F.max("id").alias("b"),
        F.bit_xor("m").alias("x"),
    )
    sizes = few_parts(cut(sizes.where("a < b")))
    release(spark)
    # of buckets with the same members one is enough
    several = few_parts(cut(sizes.where("n > 2").groupBy("n", "a", "b", "x").agg(F.min("bucket").alias("bucket")).select("bucket")))
    pairs = [few_parts(cut(sizes.where("n = 2").select("a", "b").distinct()))]
    del sizes
    release(spark)
    if "hint" not in rows.columns:
        shared = shared.withColumn("hint", F.lit(None).cast("int"))
    shared = shared.select("bucket", "id", "hint", F.col("id").alias("root"), F.lit(0).cast("long").alias("degree"))
    here = few_parts(cut(shared.join(small(several, KEYS), "bucket", "left_semi")))
    ends = pairs[0].select("a").unionByName(pairs[0].select(F.col("b").alias("a"))).select(F.col("a").alias("id"))
    ends = cut(ends.unionByName(here.select("id")).distinct())
    # checkpoints last as long as their frames
    del rows, shared, several
    if after:
        after()
    release(spark)
    verify = verifier(ends)
    del ends
    tasks = 2 * spark.sparkContext.defaultParallelism

    found, level, wide, hints, roots = [], 0, 1, None, None
    if known is not None:
        found, links, roots = [known], known, few_parts(cut(components(known)))
        known = few_parts(cut(with_degrees(roots, links)))
        here = few_parts(cut(with_roots(here, known)))
    while True:
        release(spark)
        chosen = representatives(here, level, wide, few)
        pairs.append(open_pairs(here, chosen, close, hints))
        new = few_parts(cut(reduce(DataFrame.unionByName, pairs).distinct()))
        # the next joins spread the pairs anew, unless they are broadcast
        spread = new.repartition(max(tasks, 1 + counted(new) // 10_000))
        spread._counted = counted(new)
        new = few_parts(cut(verify(spread)))
        release(spark)
        pairs = []
        if counted(new) or not found:
            found.append(new)
            roots = joined(roots, new)
            links = reduce(DataFrame.unionByName, found)
            known = few_parts(cut(with_degrees(roots, links)))
        if counted(new):
            here = with_roots(here, known)
        if here.schema["hint"].dataType.typeName() == "struct":
            # places with hints are wide: those of buckets of one component go before the rest is dealt out by place
            still = here.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket")
            here = few_parts(cut(here.join(small(few_parts(cut(still)), KEYS), "bucket", "left_semi")))
            del still
            release(spark)
        # a representative has met all others, those that left with it too
        rest = few_parts(cut(without(here, chosen)))
        of_root = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        of_bucket = of_root.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("roots"),
            F.max(F.struct("n", "root")).alias("main"),
            F.sum("n").alias("left"),
        )
        others = (F.col("left") - F.col("main.n")).alias("others")
        left = few_parts(cut(of_bucket.where("roots > 1").select("bucket", F.col("main.root").alias("main"), others)))
        if not counted(left):
            return links.distinct()
        # main and others stay with the places, for the next round's representatives
        here = few_parts(cut(rest.join(small(left, KEYS), "bucket")))
        del rest, of_root, of_bucket, chosen, left
        if hinter and not level:
            hints, more = hinter(cut(here.select("id").distinct()))
            places = here.groupBy("id").agg(F.collect_set("bucket").alias("places"))
            hints = cut(hints.join(places, "id"))
            if more is not None:
                ends = [small(known, KEYS).select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab"]
                more = more.join(ends[0], "a", "left").join(ends[1], "b", "left")
                pairs.append(more.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
        level, wide = level + 1, min(16 * wide, MOST)


def representatives(here: DataFrame, level: int, wide: int, few: int) -> DataFrame:
    """bucket, id, root, hint of this round's: one for each of `wide` parts of a bucket, or where few members are
    outside its largest component (main; others, from the second round on) all of these."""
    order = F.xxhash64("id", F.lit(level))
    part = F.pmod(F.xxhash64("id", F.lit(level), F.lit("part")), F.lit(wide))
    first = F.min(F.struct((-F.col("degree")).alias("d"), order.alias("o"), "id", "root", "hint")).alias("r")
    if "main" in here.columns:
        ends = F.col("others") <= max(few, wide)
        here = here.where(~ends | (F.col("root") != F.col("main")))
        # all places of these, as a node with several hints has several
        part = F.when(ends, F.xxhash64("id", "hint")).otherwise(part)
    out = here.groupBy("bucket", part.alias("part")).agg(first).select("bucket", "r.id", "r.root", "r.hint")
    return few_parts(cut(out))


def without(here: DataFrame, chosen: DataFrame) -> DataFrame:
    """The places of here that are not among those chosen."""
    place, told = ["bucket", "id", "hint"], ["root", "degree"]
    none = [F.lit(None).cast("long").alias(c) for c in told]
    both = here.select(*place, *told, F.lit(0).alias("c")).unionByName(chosen.select(*place, *none, F.lit(1).alias("c")))
    left = both.groupBy(*place).agg(F.max("c").alias("c"), *[F.max(c).alias(c) for c in told])
    return left.where("c = 0").select(*place, *told)


def with_roots(rest: DataFrame, known: DataFrame) -> DataFrame:
    """rest (bucket, id, hint) with the root and degree of each id."""
    if rest.schema["hint"].dataType.typeName() == "struct" and counted(known) <= KEYS:  # places with hints are wide
        x = rest.select("bucket", "id", "hint").join(F.broadcast(known), "id", "left")
        return x.select("bucket", "id", "hint", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    row = rest.select("id", F.struct("bucket", "hint").alias("row"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("degree"))
    told = known.select("id", F.lit(None).cast(row.schema["row"].dataType).alias("row"), "root", "degree")
    # an id's one row of known stands beside its places, which are not many
    mine = Window.partitionBy("id")
    both = row.unionByName(told).select("id", "row", F.max("root").over(mine).alias("root"), F.max("degree").over(mine).alias("degree"))
    both = both.where("row is not null").select("row.bucket", "id", "row.hint", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return both


def open_pairs(here: DataFrame, chosen: DataFrame, close: Close | None, hints: DataFrame | None) -> DataFrame:
    """a, b: members and representatives of one bucket that are not known to be of one component."""
    x, y = F.col("x"), F.col("y")
    chosen_rows = counted(chosen)
    on, once, more = x["root"] != y["root"], F.lit(True), []
    if hints is not None:
        here, chosen = (t.drop("hint").join(hints, "id") for t in (here, chosen))
        # of the buckets that a pair shares the first tests it
        once, more = F.array_min(F.array_intersect(x["places"], y["places"])) == F.col("bucket"), ["places"]
    if close and (hints is not None or here.schema["hint"].dataType.typeName() == "struct"):
        on = on & close(x["hint"], y["hint"], once)
    one, two = (t.select("bucket", F.struct("id", "root", "hint", *more).alias(n)) for t, n in ((here, "x"), (chosen, "y")))
    both = one.join(F.broadcast(two) if chosen_rows <= PLACES else two, "bucket").where(on)
    return both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def with_degrees(roots: DataFrame, links: DataFrame) -> DataFrame:
    """id, root, degree of the nodes with links."""
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    return roots.join(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "id")


def joined(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """id, root of the nodes with links, where roots is what it was before and new are the links that come on top."""
    if roots is None:
        return few_parts(cut(components(new)))
    one, two = (small(roots, KEYS).select(F.col("id").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    between = new.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = few_parts(cut(components(between.where("a <> b").distinct())))
    later = small(moved, KEYS).select(F.col("id").alias("root"), F.col("root").alias("now"))
    was = roots.join(later, "root", "left").select("id", F.coalesce("now", "root").alias("root"))
    # nodes that had no link before come with their new root, and those that are roots come up twice
    return few_parts(cut(was.unionByName(moved).distinct()))


def joined_here(edges: DataFrame) -> DataFrame:
    """components() of few links, on the driver."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    found = edges.toArrow()
    for u, v in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
        u, v = root(u), root(v)
        up[max(u, v)] = min(u, v)
    ids = list(up)
    out = pa.table({"id": pa.array(ids, pa.int64()), "root": pa.array([root(x) for x in ids], pa.int64())})
    return edges.sparkSession.createDataFrame(out)


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node of the links (a, b): root is the smallest id of its component."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    if counted(edges) <= EDGES:
        return joined_here(edges)
    parts = min(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + counted(edges) // SHARE)
    now = None
    while True:
        # large star: the larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.repartition(parts, "u").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(1).alias("more"))
        both = low.select("u", F.col("m").alias("v"), F.lit(0).alias("more")).unionByName(rest)
        seen, of = Observation(), F.when(F.col("more") == 0, F.xxhash64("u", "v"))
        state = [F.sum("more").alias("m"), F.count(of).alias("n"), F.bit_xor(of).alias("x"), F.sum(F.shiftright(of, 24)).alias("s")]
        edges = few_parts(cut(both.observe(seen, *state))).select("u", "v")
        release(links.sparkSession)
        before, now = now, seen.get
        if now == before and not now["m"]:  # every node has one edge, the same as before
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
