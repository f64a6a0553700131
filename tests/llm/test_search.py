"""Top-k and nearest neighbours against brute force."""

import math
import random

from pyspark.sql import functions as F

from lorekeep.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, id string, v int, score int, rank int"


def rows(n, seed=1, width=8):
    r = random.Random(seed)
    out = [(i, [r.uniform(-1, 1) for _ in range(width)], "x", 1, 2, 3) for i in range(n)]
    out[3] = (3, None, "x", 1, 2, 3)
    out[5] = (5, [1.0, None] + [0.0] * (width - 2), "x", 1, 2, 3)
    out[7] = (7, [float("nan")] * width, "x", 1, 2, 3)
    out[9] = (9, [float("inf")] * width, "x", 1, 2, 3)
    out[11] = (11, [0.0] * width, "x", 1, 2, 3)
    for i in range(20, 60):  # copies of one vector: ties
        out[i] = (i, [0.5] * width, "x", 1, 2, 3)
    out[0] = (0, [0.5] * width, "x", 1, 2, 3)
    return out


def clean(df, zero=True):
    out = []
    for r in df.collect():
        v = r.embedding
        if r.vec_id is None or v is None or any(c is None or not math.isfinite(c) for c in v) or (not zero and not any(v)):
            continue
        out.append((r.vec_id, [float(c) for c in v]))
    return out


def brute(vectors, chosen, k, measure):
    found = set()
    for q, a in {i: a for i, a in vectors if chosen(i)}.items():
        s = sorted(((-measure(a, b), i) for i, b in vectors if i != q))
        found |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return found


def integer(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b, strict=False))


def test_top_k(spark):
    df = spark.createDataFrame(rows(300), SCHEMA).repartition(5)
    for bins, block in ((64, 2048), (1024, 20)):
        got = topk.top_k(df, F.col("id") % 10 == 0, k=10, bins=bins, block=block)
        assert {tuple(r) for r in got.collect()} == brute(clean(df), lambda i: i % 10 == 0, 10, integer)


def test_top_k_of_very_large_components(spark):
    big = [(i, [v, 1.0], "x", 1, 2, 3) for i, v in enumerate((1e17, -1e17, 3e16, 1.0, 1e300, -1e12, 2.5))]
    df = spark.createDataFrame(big, SCHEMA.replace("array<float>", "array<double>"))
    held = lambda x: max(-(2**63), min(2**63 - 1, math.floor(1024 * x)))

    def measure(a, b):
        s = sum(int(float(held(x))) * int(float(held(y))) for x, y in zip(a, b, strict=True))
        return max(-topk.MOST, min(topk.MOST, s))

    got = topk.top_k(df, F.col("id") % 2 == 0, k=4)
    assert {tuple(r) for r in got.collect()} == brute(clean(df), lambda i: i % 2 == 0, 4, measure)


def test_top_k_repeated_rows_few_rows_and_none(spark):
    few = spark.createDataFrame([r for r in rows(300)[20:26]] * 2, SCHEMA)
    got = topk.top_k(few, F.col("id") % 10 == 0, k=10)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(20, i) for i in range(21, 26) for _ in range(2)]
    assert topk.top_k(few.limit(0), F.col("id") % 10 == 0).count() == 0
    assert topk.top_k(few.where("vec_id = 20"), F.col("id") % 10 == 0).count() == 0


def cosine(a, b):
    dot = na = nb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return dot / (math.sqrt(nb) * math.sqrt(na))


def test_neighbours_are_exact_where_all_are_reranked(spark):
    df = spark.createDataFrame(rows(300), SCHEMA).repartition(3)
    got = {tuple(r) for r in ann.search(df, F.col("id") % 10 == 0, k=5).collect()}
    want = brute(clean(df, zero=False), lambda i: i % 10 == 0, 5, cosine)
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert max(abs(a[3] - b[3]) for a, b in zip(sorted(got), sorted(want), strict=True)) < 1e-12


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame(rows(300), SCHEMA)
    assert ann.search(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert ann.search(df.where("vec_id = 11"), F.col("id") % 11 == 0).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(2)
    got = {(r.query_id, r.vec_id) for r in ann.search(df, F.col("id") % 50 == 0, k=5, floor=64).collect()}
    want = {x[0::2] for x in brute(clean(df, zero=False), lambda i: i % 50 == 0, 5, cosine)}
    assert len(got & want) / len(want) >= 0.9
