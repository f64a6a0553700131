"""Line deduplication against exact Jaccard of all pairs."""

import random

from pyspark.sql import functions as F

from lorekeep.llm import line_dedup
from lorekeep.llm.common import counted

from .test_near_dup import roots


def shingles(line):
    u = line.encode("utf-16-be")
    n = max(1, len(u) // 2 - 7)
    return {u[2 * i : 2 * i + 16] for i in range(n)}


def brute(rows):
    """doc_id -> text, for documents with unique ids."""
    first = {}
    lines = sorted({x for _, t in rows if t for x in t.split("\n") if x.strip()})
    for i, t in rows:
        for x in (t or "").split("\n"):
            if x in first:
                first[x] = min(first[x], i)
            else:
                first[x] = i
    sets = [shingles(x) for x in lines]
    links = [(a, b) for a in range(len(lines)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = roots(range(len(lines)), links)
    number = {x: root[k] for k, x in enumerate(lines)}
    keep = {}
    for x, k in number.items():
        keep[k] = min(keep.get(k, 10**9), first[x])
    out = {}
    for i, t in rows:
        seen, left = set(), []
        for x in (t or "").split("\n"):
            if x.strip():
                k = number[x]
                if keep[k] != i or k in seen:
                    continue
                seen.add(k)
            left.append(x)
        out[i] = None if t is None else "\n".join(left)
    return out


def corpus(seed=1):
    r = random.Random(seed)
    line = lambda n: " ".join("".join(r.choice("aeioust") for _ in range(r.randrange(1, 8))) for _ in range(n))
    bases = [line(r.randrange(3, 40)) for _ in range(40)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(r.randrange(6)):
            kind = r.random()
            x = r.choice(bases)
            if kind < 0.3:
                k = r.randrange(len(x))
                x = x[:k] + r.choice("xyzé\U0001f600") + x[k + 1 :]
            elif kind > 0.6:
                x = line(r.randrange(1, 30))
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    family = line(60)
    rows += [(1000 + i, f"{family} {i}\n\n  \nshort") for i in range(80)]
    return rows + [(2000, None), (2001, ""), (2002, "\n\n"), (2003, "x" * 30_000), (2004, "x" * 30_001)]


def test_lines(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z", 0) for r in rows], "doc_id long, text string, pos int, line string, n_chars int")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute(rows)
    out = line_dedup.without_repeated_lines(df)
    assert out.columns == df.columns and all((r.n_chars or 0) == len(r.text or "") for r in out.collect())


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same line here"), (1, "same line here"), (None, "same line here"), (2, "same line here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(df).collect())
    assert got == [("1", "same line here"), ("1", "same line here"), ("2", ""), ("None", "same line here")]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rows_of_one_id(spark):
    """Rows of one id with different texts are different documents: a line that one of them repeats stays in no other's place."""
    rows = [
        (0, "shared line number one"),
        (1, "shared line number one\nkeep b here ok now"),
        (1, "unique other line zz qq\nkeep c different text"),
    ]
    got = sorted(r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == ["keep b here ok now", "shared line number one", "unique other line zz qq\nkeep c different text"]


def test_bitmaps_have_the_bits_of_all_shingles(spark):
    hashes = [[], [0], [-1], [i << 52 for i in range(-2048, 2048)], [h * 0x9E3779B97F4A7C1 % 2**63 for h in range(300)]]
    rows = spark.createDataFrame(list(enumerate(hashes)), "i int, s array<long>")
    got = rows.select("i", line_dedup.firsts("s").alias("v")).select("i", "v", line_dedup.bitmap(F.col("v")).alias("bits")).collect()
    for r in got:
        want = {(h % 2**64) >> 52 for h in hashes[r.i]}
        assert len(r.v) == len(want) and set(r.v) == want and len(r.bits) == line_dedup.WORDS
        assert {64 * w + b for w, x in enumerate(r.bits) for b in range(64) if (x % 2**64) >> b & 1} == want


def test_only_the_texts_of_few_pairs_are_sent(spark, monkeypatch):
    lines = spark.createDataFrame([(i, f"line {i // 2} with some more words that are the same {'x' * (i % 2)}") for i in range(40)], "h1 long, line string")
    found, plans = [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for most in (0, 1000):
        monkeypatch.setattr(line_dedup, "PAIRS", most)
        monkeypatch.setattr(line_dedup, "WANTED", most)
        verify = line_dedup.Lines(lines).verifier(line_dedup.cut(lines.select(F.col("h1").alias("id"))))
        pairs = line_dedup.cut(spark.createDataFrame([(a, b) for a in range(40) for b in range(a + 1, min(a + 3, 40))], "a long, b long"))
        out = verify(pairs)
        plans.append(out._jdf.queryExecution().toString())
        found.append(sorted(tuple(r) for r in out.collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and {(a, a + 1) for a in range(0, 40, 2)} <= set(found[0])
    assert "BroadcastHashJoin" not in plans[0] and "BroadcastHashJoin" in plans[1]


def test_hints_come_from_each_line_alone(spark, monkeypatch):
    """No row a shingle, which took the disk of many times the lines; and close tells no similar lines apart."""
    made = sorted({x for _, t in corpus(4) if t for x in t.split("\n") if x.strip()})
    lines = line_dedup.cut(spark.createDataFrame(list(enumerate(made)), "h1 long, line string"))
    ids, plans, real = line_dedup.cut(lines.select(F.col("h1").alias("id"))), [], line_dedup.cut
    candidates = line_dedup.Lines(lines)
    verify = candidates.verifier(ids)
    monkeypatch.setattr(line_dedup, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or real(df))
    hints, more = candidates.hinter(ids)
    assert more is None and len(plans) == 1 and "Generate" not in plans[0]
    x, y = (hints.select(F.col("id").alias(i), F.col("hint").alias(f"h{i}")) for i in "ab")
    pairs = real(x.crossJoin(y).where("a < b"))
    far = pairs.where(~line_dedup.close(F.col("ha"), F.col("hb"), F.lit(True))).select("a", "b")
    sets = [shingles(t) for t in made]
    want = {(a, b) for b in range(len(made)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in verify(real(pairs.select("a", "b"))).collect()} == want
    apart = {tuple(r) for r in far.collect()}
    assert want and not want & apart and len(apart) > 0.9 * (counted(pairs) - len(want))


def test_verification_makes_the_shingles_of_a_line_once(spark):
    lines = line_dedup.cut(spark.createDataFrame([(i, f"line {i} with words") for i in range(9)], "h1 long, line string"))
    verify = line_dedup.Lines(lines).verifier(line_dedup.cut(lines.select(F.col("h1").alias("id"))))
    out = verify(line_dedup.cut(spark.createDataFrame([(a, a + 1) for a in range(8)], "a long, b long")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 2


def test_signatures_go_before_lines_are_verified(spark, monkeypatch):
    seen, real = [], line_dedup.Lines.verifier

    def verifier(self, ids):
        seen.append(spark._jsparkSession.sharedState().cacheManager().isEmpty())
        return real(self, ids)

    spark.catalog.clearCache()
    monkeypatch.setattr(line_dedup.Lines, "verifier", verifier)
    assert line_dedup.decisions(spark.createDataFrame(corpus()[:40], "doc_id long, text string")).count() and seen == [True]
