"""Near-duplicate documents: distances and classes against brute force."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lorekeep.llm import linking, near_dup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30), st.integers(0, 30))
def test_edit_distance(a, b, most):
    d = plain_distance(a, b)
    assert near_dup.edit_distance(np.array(a, np.int64), np.array(b, np.int64), most) == (d if d <= most else None)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=40), st.data())
def test_linked(a, data):
    """The bounds before the alignment change no decision."""
    b = list(a)
    for _ in range(data.draw(st.integers(0, 12))):
        k = data.draw(st.integers(0, len(b)))
        b[k : k + data.draw(st.integers(0, 2))] = data.draw(st.lists(st.integers(0, 6), max_size=2))
    x, y = (near_dup.Words(near_dup.word_hashes([str(w) for w in t])) for t in (a, b))
    if b:
        d = plain_distance(a, b)
        assert d <= near_dup.at_most(x, y)
        assert near_dup.linked(x, y) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))


def roots(n, links):
    up = {i: i for i in n}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 300)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)]
    got = {x.id: x.root for x in linking.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert {k: got.get(k, k) for k in want} == want
    assert linking.components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus(seed=1):
    """Documents, and groups of near copies of one of them each."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7))) for _ in range(800)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, i = [], 0
    shared = text(40)  # a passage in many unrelated documents
    for n, copies in ((120, 60), (200, 3), (30, 5), (400, 2), (8, 1), (90, 40)):
        base = text(n)
        for c in range(copies):
            w = list(base)
            for _ in range(round(0.02 * n) if c else 0):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w)))
            i += 1
        rows.append((i, " ".join(base)))
        i += 1
    for _ in range(60):
        rows.append((i, " ".join(shared + text(r.randrange(60, 120)))))
        i += 1
    rows += [(i, ""), (i + 1, None), (i + 2, "one two"), (i + 3, "one two"), (i + 3, "one two"), (None, "one two"), (i + 5, "word " * 6000), (i + 6, "word " * 6001)]
    r.shuffle(rows)
    return rows


def test_classes(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, id int, keys string, bucket int")
    got = near_dup.classes(df).collect()
    texts = {i: (t or "").split() for i, t in rows if i is not None}
    links = []
    for a in texts:
        for b in texts:
            if a < b:
                longest = max(len(texts[a]), len(texts[b]))
                if abs(len(texts[a]) - len(texts[b])) <= 0.2 * longest and (texts[a] == texts[b] or longest < 1000 and plain_distance(texts[a], texts[b]) <= int(0.2 * longest + 1e-9) or longest > 1000):
                    links.append((a, b))
    want = roots(texts, links)
    assert {r.doc_id: r.class_id for r in got} == want
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows if i is not None)
    kept = near_dup.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1


def test_recall_by_edits(spark):
    """Copies with changed words all over: nearly all are found up to 15 % of edits, fewer at 20 %, and none beyond."""
    r = random.Random(7)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, rates = [], (5, 10, 15, 20, 25)
    for rate in rates:
        for n in (60, 200) * 25:
            a = text(n)
            b = list(a)
            for k in r.sample(range(n), rate * n // 100):
                b[k] = f"x{r.randrange(5000)}"
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {x.doc_id: x.class_id for x in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [sum(got[i + 1] == got[i] == i for i in range(100 * k, 100 * k + 100, 2)) / 50 for k in range(len(rates))]
    assert min(found[:3]) >= 0.9 and found[3] >= 0.5 and found[4] == 0, found


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dup.classes(df).count() == 0 and near_dup.one_of_each(df).count() == 0


def test_a_group_of_pairs_gets_a_text_once(spark):
    """All pairs of 40 texts, and pairs of others: those that pass are the same, and texts come once a group."""
    n = 40
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)] + [(1000 + 2 * i, 1001 + 2 * i) for i in range(200)]
    ids = sorted({i for p in pairs for i in p} - {1001})  # a pair without its text is not linked
    texts = near_dup.cut(spark.createDataFrame([(i, f"text {i}") for i in ids], "h1 long, text string"))
    sent = spark.sparkContext.accumulator(0)

    def tested(some, held):
        sent.add(len(held))
        assert all(held[i].as_py() == f"text {i}" for p in some for i in p)
        return [(a + b) % 3 == 0 for a, b in some]

    found = near_dup.in_groups(near_dup.cut(spark.createDataFrame(pairs, "a long, b long")), texts, tested)
    assert sorted(map(tuple, found.collect())) == [p for p in pairs if sum(p) % 3 == 0 and 1001 not in p]
    assert len(ids) <= sent.value <= 1.5 * len(pairs)  # by the pair there were two each
