"""The model against a plain Kneser-Ney, both scoring paths, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import quality


def plain(train, text):
    """Perplexity of text, from dictionaries of strings."""
    order = quality.ORDER
    grams = Counter()
    for t in train:
        x = quality._START + t
        grams.update(x[i : i + order] for i in range(len(t)))
    types = {order: grams}
    for m in range(order - 1, 0, -1):
        types[m] = Counter(g[1:] for g in types[m + 1])
    d, ctx = {}, {}
    for m, t in types.items():
        n = Counter(t.values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d[m] = [min(i, max(0.0, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
        else:
            d[m] = [0.5] * 3
        ctx[m] = defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            ctx[m][g[:-1]][0] += c
            ctx[m][g[:-1]][1] += d[m][min(c, 3) - 1]

    def p(g):
        m = len(g)
        if not m:
            return 2.0**-quality.BITS
        if g[:-1] not in ctx[m]:
            return p(g[1:])
        total, held = ctx[m][g[:-1]]
        c = types[m].get(g, 0)
        return ((c - d[m][min(c, 3) - 1]) / total if c else 0.0) + held / total * p(g[1:])

    x = quality._START + text
    return math.exp(-sum(math.log(p(x[i : i + order])) for i in range(len(text))) / len(text))


TRAIN = ["the cat sat on the mat and the dog sat too", "a dog and a cat", "the end of the tale of the cat", "abracadabra über alles", "x"]
TEXTS = ["the dog sat", "zzz qqq", "überall the cats \U0001f600\U0001f600", "a", "the cat " * 500, *TRAIN]


def test_probabilities_and_both_paths(spark, monkeypatch):
    tables = quality.kneser_ney(quality.cut(quality.counts(spark.createDataFrame([(t,) for t in [*TRAIN, None, ""]], "text string"))))
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(TEXTS)] + [(50, None, None), (51, "fr", ""), (None, "en", "a"), (0, "en", TEXTS[0])], "doc_id long, lang string, text string")
    for most in (quality.BROADCAST_GRAMS, 0):
        monkeypatch.setattr(quality, "BROADCAST_GRAMS", most)
        rows = quality.perplexities(docs, tables).collect()
        got = {r.doc_id: r.perplexity for r in rows}
        assert len(rows) == len(TEXTS) + 4 and got[50] is None and got[51] is None
        for i, t in enumerate(TEXTS):
            assert abs(got[i] / plain(TRAIN, t) - 1) < 1e-4


def test_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**60, 5000))
    t = quality.Table(keys[::2], np.arange(len(keys[::2]), dtype=np.float32))
    v, found = t.get(keys)
    assert found[::2].all() and not found[1::2].any() and (v[::2] == np.arange(len(keys[::2]))).all()
    assert not quality.Table(keys[:0], np.zeros(0, np.float32)).get(keys)[1].any()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = quality.judged(docs, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {(r.quality, r.toxic): r.kept for r in x}
    assert kept[(1, 0)] > 0.97 and kept[(0, 0)] < 0.35


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "en", "some text", 5), (2, "en", "", 5), (3, None, None, 5), (4, "fr", "word " * 50_000, 5), (4, "fr", "other", 5)], "doc_id long, lang string, text string, mark int")
    assert sorted(r.text for r in quality.accepted(docs, labels).collect()) == ["other", "some text", "word " * 50_000]
    assert quality.judged(docs.limit(0), labels).count() == 0 and quality.judged(docs, labels.limit(0)).where("kept").count() == 3
