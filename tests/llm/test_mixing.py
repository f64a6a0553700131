"""The mix against targets computed one source at a time."""

import re
from collections import Counter, defaultdict

from lorekeep.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, cap=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


def check(rows, got, exact=True):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want = water(sizes)
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= (1 if exact else 0.01 * t), (s, taken[s], t)


SCHEMA = "doc_id long, text string, source string, size int, target string, taken string, block int"


def case():
    rows = [(i, "w\x0b " * (i % 37) + " x", "hot" if i % 3 else f"s{i % 11}", 1, "x", "y", 0) for i in range(900)]
    rows += [(5000, None, "a", 1, "x", "y", 0), (5001, "", None, 1, "x", "y", 0), (5002, "one two", None, 1, "x", "y", 0), (5003, " \n", "empty", 1, "x", "y", 0)]
    return rows + [(7, "again and again", "hot", 1, "x", "y", 0)] * 5 + [(None, "no id", "hot", 1, "x", "y", 0)]


def test_mix(spark):
    rows = case()
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    check(rows, got)
    small = mixing.mix(df.repartition(7), shard_words=256, block=8)
    check(rows, small.collect(), exact=False)
    assert sorted(map(str, small.collect())) == sorted(map(str, mixing.mix(df.repartition(3), shard_words=256, block=8).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0


def test_documents_hold_the_words_taken(spark):
    rows = case()
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    size, got, sources = Counter(), Counter(), Counter()
    for r in rows:
        size[(r[0], r[2])] += len(WORD.findall(r[1] or ""))
        sources[r[2]] += len(WORD.findall(r[1] or ""))
    for r in out.collect():
        got[(r.doc_id, r.source)] += len(WORD.findall(r.text))
    assert all(0 < got[k] <= 3 * size[k] for k in got)
    for s, t in water(sources).items():
        assert abs(sum(v for k, v in got.items() if k[1] == s) - t) <= 1


def test_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text, r.source) for r in df.collect()], mixing.mix(df).collect())
