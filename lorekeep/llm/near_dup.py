"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers of a document are its runs of five words, each labelled with its occurrence number (the third time a run
comes up it is another k-mer). Under each of FUNCTIONS hash functions the smallest k-mer is sampled together with its
place. Two of the sampled k-mers (of functions that are neighbours in a ring, 36 times two) in the order in which they stand in
the text are a signature: equal signatures need equal k-mers in equal order, which makes them sensitive to edit
similarity and not only to shared content. Sampled
k-mers that no other text samples are dropped after counting, before the signatures are made, so that texts without a
relative make none. Texts with an equal signature are candidates (linking.py), and a pair is linked if its word edit
distance is at most a fifth of the longer text's words: similarity 0.8.

The distance comes from an alignment banded by the number of edits allowed: for each count of edits, the furthest place
reached on each diagonal of the band, extended over equal words by comparing hashes of runs. Before it, two exact bounds
settle most pairs: from below, runs of one to four words that only one text has; from above, the cost of the alignment
through the runs of four words that come up once in either text.

Copies of one text are one node; each document gets the class of its text. Edge cases. A null text is an empty one, and
empty texts are copies of each other. A text of less than five words has one k-mer, all its words. Texts of very many
words are aligned in full. Documents with a null id have no class. Rows with one id and different texts are judged by
their texts. Repeated rows are copies and are all returned; keeping one of each class keeps one row of them, that with
the smallest id and, of one id, the smallest hash of the text. Texts whose first hashes collide while the second ones
differ are classes of their own. An empty table gives no rows; extra columns do not take part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import counted, cut, few_parts, keeps, small, text_of
from .linking import KEYS, components, links_in_buckets

K, FUNCTIONS, SIMILARITY, BINS = 5, 36, 0.8, 512
#: Which two functions make a signature: those so far apart in a ring.
APART = (1,)
#: Words of the texts that are handled at once.
PART = 50_000
#: Pairs of texts that are tested as one group: two to this power at most.
GROUP_BITS = 11
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"sketch", i) for i in range(FUNCTIONS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def runs(h: np.ndarray, k: int = K) -> np.ndarray:
    """A hash for each run of k words; one for a text of fewer."""
    if not len(h):
        return h
    k = min(k, len(h))
    g = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        g += h[j : len(h) - k + 1 + j] * _ODD[j]
    return mixed(g)


def labelled(g: np.ndarray) -> np.ndarray:
    """The hashes with their occurrence numbers mixed in."""
    order = np.argsort(g, kind="stable")
    s = g[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return g
    at = np.arange(len(s))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(g)
    out[order] = s + nth.astype(np.uint64) * _ODD[0]
    return out


def minima(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each of some texts, given by the hashes of their words (one at least), a row with its sampled k-mers, one for
    each function, and one with their places. The k-mers of all texts lie in one array."""
    grams = [labelled(runs(h)) for h in held]
    g = np.concatenate(grams)
    n = np.array([len(x) for x in grams])
    starts = np.cumsum(n) - n
    text = np.repeat(np.arange(len(n)), n)
    keys, places = np.zeros((len(n), FUNCTIONS), np.uint64), np.zeros((len(n), FUNCTIONS), np.int32)
    for f, seed in enumerate(_SEEDS):
        x = mixed(g ^ seed)
        low = np.minimum.reduceat(x, starts)
        at = np.flatnonzero(x == low[text])[::-1]
        keys[:, f] = low
        places[text[at], f] = at - starts[text[at]]  # the first of equal ones is written last
    return keys, places


def bag(h: np.ndarray) -> np.ndarray:
    """How many words have each of BINS hashes, 127 at most."""
    return np.minimum(127, np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS)).astype(np.int8)


def close(x: Column, y: Column, once: Column) -> Column:
    """False for two hints (words, bag) whose texts have more words without a partner than edits are allowed."""
    allowed = F.floor((1 - SIMILARITY) * F.greatest(x["words"], y["words"]) + 1e-9)

    def more(p: Column, q: Column) -> Column:
        zero = F.lit(0)
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.greatest(zero, a.cast("int") - b.cast("int"))), zero, lambda s, v: s + v)

    apart = F.abs(x["words"] - y["words"])
    return (apart <= allowed) & once & (more(x["bag"], y["bag"]) <= allowed) & (more(y["bag"], x["bag"]) <= allowed)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance of two integer arrays if it is at most `most`, else None."""
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return None
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        tail = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    # words that only one text has bound the distance from below
    both, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = np.bincount(place[:n], minlength=len(both)), np.bincount(place[n:], minlength=len(both))
    if max(n, m) - int(np.minimum(ca, cb).sum()) > most:
        return None
    wa, wb = place[:n], place[n:]
    power = np.cumprod(np.full(max(n, m) + 1, _ODD[0], np.uint64))
    key = mixed(np.arange(len(both), dtype=np.uint64) + np.uint64(1))
    sa = np.concatenate([[np.uint64(0)], np.cumsum(key[place[:n]] * power[:n])])
    sb = np.concatenate([[np.uint64(0)], np.cumsum(key[place[n:]] * power[:m])])
    steps = [1 << i for i in range(min(n, m).bit_length() - 1, -1, -1)]
    most = min(most, max(n, m))
    wide = most + 1
    reach = np.full(2 * wide + 3, -(1 << 40), np.int64)  # furthest place in a, by diagonal (place in a - place in b)
    spare = reach.copy()
    for e in range(most + 1):
        lo, hi = wide - e, wide + e + 1
        if e == 0:
            x = np.zeros(1, np.int64)
        else:
            was = reach
            x = np.maximum(np.maximum(was[lo:hi] + 1, was[lo - 1 : hi - 1] + 1), was[lo + 1 : hi + 1])
        d = np.arange(-e, e + 1)
        x = np.minimum(x, np.minimum(n, m + d))
        ok = (x >= 0) & (x - d >= 0)
        x = np.where(ok, x, -(1 << 40))
        # places where the next words are equal are extended, by halving steps
        more = np.flatnonzero(ok & (x < n) & (x - d < m))
        more = more[wa[x[more]] == wb[x[more] - d[more]]]
        if len(more):
            p, q = x[more], x[more] - d[more]
            for step in steps:
                fits = (p + step <= n) & (q + step <= m)
                i, j = p[fits], q[fits]
                fits[fits] = (sa[i + step] - sa[i]) * power[j] == (sb[j + step] - sb[j]) * power[i]
                p, q = p + step * fits, q + step * fits
            x[more] = p
        reach, spare = spare, reach
        reach[lo - 1 : hi + 1] = -(1 << 40)
        reach[lo:hi] = x
        if abs(n - m) <= e and reach[wide + n - m] >= n:
            return e
    return None


class Words:
    """The word hashes of a text, its different words with their counts, and its runs of four words that come up once,
    sorted, with their places."""

    RUN = 4

    def __init__(self, h: np.ndarray):
        self.h = h
        self.words, self.counts = np.unique(h, return_counts=True)
        keys, places, times = np.unique(runs(h, self.RUN), return_index=True, return_counts=True)
        self.keys, self.places = keys[times == 1], places[times == 1]

    def __len__(self):
        return 4 * len(self.h)


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the equal elements of two sorted arrays of different elements."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = np.flatnonzero(a[at] == b)
    return at[same], same


def shared_runs(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """How many runs of k words two texts share, each as often as both have it."""
    (x, nx), (y, ny) = (np.unique(runs(t, k), return_counts=True) for t in (a, b))
    i, j = meeting(x, y)
    return int(np.minimum(nx[i], ny[j]).sum())


def at_most(a: Words, b: Words) -> int:
    """An upper bound of the edit distance: the cost of the alignment through the runs of words that come up once in
    either text and are crossed by no other of them."""
    n, m = len(a.h), len(b.h)
    if min(n, m) < Words.RUN:
        return max(n, m)
    x, y = meeting(a.keys, b.keys)
    i, j = a.places[x], b.places[y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    straight = (np.maximum.accumulate(j) == j) & (np.minimum.accumulate(j[::-1])[::-1] == j)
    i, j = np.r_[-1, i[straight], n], np.r_[-1, j[straight], m]
    gi, gj = np.diff(i) - 1, np.diff(j) - 1
    even = gi == gj
    cost = int(np.maximum(gi, gj)[~even].sum())
    wide = gi[even]
    inside = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
    at = np.repeat(i[:-1][even] + 1, wide) + inside
    return cost + int((a.h[at] != b.h[at + np.repeat((j - i)[:-1][even], wide)]).sum())


def linked(a: Words, b: Words, similarity: float = SIMILARITY) -> bool:
    """Whether two texts have this word edit similarity."""
    longest, least = max(len(a.h), len(b.h)), min(len(a.h), len(b.h))
    allowed = int((1 - similarity) * longest + 1e-9)
    if longest - least > allowed:
        return False
    i, j = meeting(a.words, b.words)
    if int(np.minimum(a.counts[i], b.counts[j]).sum()) < longest - allowed:
        return False
    if at_most(a, b) <= allowed:
        return True
    for k in (2, 3, 4):  # an edit changes k runs at most
        needed = longest - k + 1 - k * allowed
        if least >= k and needed > 0 and shared_runs(a.h, b.h, k) < needed:
            return False
    return edit_distance(a.h, b.h, allowed) is not None


class Recent:
    """What was made of the texts last asked for, by id, up to so many numbers in all: 32 MB."""

    def __init__(self, make, most: int = 4_000_000):
        self.make, self.most, self.size, self.held = make, most, 0, {}

    def get(self, i: int, text: pa.StringScalar) -> np.ndarray:
        g = self.held.pop(i, None)
        if g is None:
            g = self.make(text.as_py())
            self.size += len(g)
        self.held[i] = g  # as the latest
        while self.size > self.most and len(self.held) > 2:
            self.size -= len(self.held.pop(next(iter(self.held))))
        return g


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), words, mins, places, bag for each row of docs with an id."""

    def parts(texts):
        held, size = [], 0
        for t in texts:
            held.append(word_hashes(t.as_py().split()))
            size += len(held[-1])
            if size >= PART:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches):
        keeps("minhash")
        for batch in batches:
            at = 0
            for held in parts(batch.column(3)):
                some = [h for h in held if len(h)]
                words = np.array([len(h) for h in held])
                ends = np.r_[0, np.cumsum(np.where(words, FUNCTIONS, 0))].astype(np.int32)
                keys, places = minima(some) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (keys.reshape(-1).view(np.int64), places.reshape(-1))]
                bags = pa.ListArray.from_arrays(np.arange(0, BINS * len(held) + 1, BINS, np.int32), pa.array(np.concatenate([bag(h) for h in held])))
                columns = [*batch.slice(at, len(held)).columns[:3], pa.array(words, pa.int32()), *lists, bags]
                at += len(held)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "words", "mins", "places", "bag"])

    t = text_of()
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2"), t.alias("text"))
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, words int, mins array<long>, places array<int>, bag array<tinyint>")


def order_buckets(nodes: DataFrame) -> DataFrame:
    """id, bucket: for each text the signatures of its sampled k-mers, two and two, that others sample too.
    nodes: id, mins, places."""
    sampled = nodes.select("id", F.posexplode(F.arrays_zip("mins", "places")).alias("f", "s"))
    sampled = sampled.select(F.xxhash64("f", "s.mins").alias("key"), "id", F.col("f").cast("tinyint").alias("f"), F.col("s.places").alias("at"))
    several = sampled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    shared = sampled.join(several, "key").groupBy("id")
    shared = shared.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("key", "at")))).alias("s"))

    def signature(f: int, g: int) -> Column:
        x, y = (F.col("s")[F.lit(i).cast("tinyint")] for i in (f, g))
        first, second = F.xxhash64(F.lit(f), x["key"], F.lit(g), y["key"]), F.xxhash64(F.lit(g), y["key"], F.lit(f), x["key"])
        return F.when(x.isNotNull() & y.isNotNull(), F.when(x["at"] <= y["at"], first).otherwise(second))

    made = F.array(*[signature(f, (f + d) % FUNCTIONS) for d in APART for f in range(FUNCTIONS)])
    return shared.where(F.size("s") > 1).select("id", F.explode(made).alias("bucket")).where("bucket is not null")


def verifier(docs: DataFrame):
    """For linking.py: pairs (a, b) of text hashes -> those that are linked, by alignment of their whole texts."""

    def run(batches):
        recent = Recent(lambda text: Words(word_hashes(text.split())))
        for batch in batches:
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            texts = zip(batch.column(2), batch.column(3), strict=True)
            good = [linked(recent.get(a, ta), recent.get(b, tb)) for (a, b), (ta, tb) in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def of(ids: DataFrame):
        texts = texts_of(docs, ids)

        def verify(pairs: DataFrame) -> DataFrame:
            return with_texts(pairs, texts).mapInArrow(run, "a long, b long")

        return verify

    return of


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """h1, text of the texts with these hashes, once each."""
    wanted = small(ids.select(F.col("id").alias("h1")), 200_000)
    rows = docs.where("doc_id is not null").select(F.xxhash64(text_of()).alias("h1"), text_of().alias("text"))
    return cut(rows.join(wanted, "h1", "left_semi").dropDuplicates(["h1"]))


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, ta, tb."""
    one, two = (texts.select(F.col("h1").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")


def in_groups(pairs: DataFrame, texts: DataFrame, tested: Callable[[list, dict], list]) -> DataFrame:
    """a, b: those of some pairs (counted) that are linked. tested: pairs (a, b), in an order in which neighbours share
    texts, and the texts (Arrow's) by id -> whether each is linked.

    Pairs of relatives share their smallest neighbours. By these they are put in order and cut into groups, and a group
    gets each of its texts once, not once a pair, so that what is made of a text serves all its pairs there."""
    tasks, bits = 2 * pairs.sparkSession.sparkContext.defaultParallelism, 5
    while bits < GROUP_BITS and counted(pairs) >> (bits + 1) >= 2 * tasks:
        bits += 1
    ends = pairs.select(F.col("a").alias("id"), F.col("b").alias("o")).unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("o")))
    low = ends.groupBy("id").agg(F.least(F.min("o"), F.first("id")).alias("low"))
    low = small(few_parts(cut(low)), KEYS)
    one, two = (low.select(F.col("id").alias(x), F.col("low").alias(f"l{x}")) for x in "ab")
    order = [F.least("la", "lb").alias("key"), "a", "b"]
    x = pairs.join(one, "a").join(two, "b").select(*order)
    # ranges of about as many pairs each, so that no group is larger than the others whatever its relatives are
    x = x.repartitionByRange(1 + counted(pairs) // 20_000, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    x = cut(x.select(F.shiftright(F.monotonically_increasing_id(), bits).alias("g"), "a", "b"))
    wanted = x.select(F.col("g").alias("of"), F.explode(F.array("a", "b")).alias("h1")).distinct().join(texts, "h1")
    parts = max(tasks, 1 + (counted(pairs) >> bits) // 4)

    def run(some: pa.Table, own: pa.Table) -> pa.Table:
        some = some.select(["a", "b"]).sort_by([("a", "ascending"), ("b", "ascending")])
        held = dict(zip(own.column("h1").to_pylist(), own.column("text"), strict=True))
        both = [(a, b) for a, b in zip(*(c.to_pylist() for c in some.columns), strict=True) if a in held and b in held]
        good = [p for p, ok in zip(both, tested(both, held), strict=True) if ok]
        return pa.table({n: pa.array([p[i] for p in good], pa.int64()) for i, n in enumerate("ab")})

    some, own = x.repartition(parts, "g").groupBy("g"), wanted.repartition(parts, "of").groupBy("of")
    return some.cogroup(own).applyInArrow(run, "a long, b long")


def classes_of(rows: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, h1, class_id (the smallest doc_id of the class) for each of rows (doc_id, h1, h2). links: of h1."""
    x = rows.select("doc_id", "h1", "h2").join(cut(components(links)), rows["h1"] == F.col("id"), "left")
    # texts that are linked to none are told apart by both hashes
    x = x.select("doc_id", "h1", F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(0).alias("c2"))
    first = x.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    x = x.join(small(cut(first.select("c1", "c2", "class_id"))), ["c1", "c2"], "left")
    return x.select("doc_id", "h1", F.coalesce("class_id", "doc_id").alias("class_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, h1 (hash of the text), class_id (the smallest doc_id of its class) for each row of docs with an id."""
    rows = cut(signatures(docs))
    both = [F.min("h2").alias("lo"), F.max("h2").alias("hi")]
    nodes = rows.groupBy(F.col("h1").alias("id")).agg(*both, *[F.first(c).alias(c) for c in ("words", "mins", "places", "bag")])
    nodes = cut(nodes.where("lo = hi"))
    hints = nodes.select("id", F.struct("words", "bag").alias("hint"))
    links = cut(links_in_buckets(order_buckets(nodes), verifier(docs), close, lambda ids: (ids.join(hints, "id"), None)))
    return classes_of(rows, links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class. Rows without an id stay."""
    found = cut(classes(docs).groupBy("class_id", "doc_id", "h1").agg(F.count(F.lit(1)).alias("n")))
    stays = found.where("doc_id = class_id").groupBy("class_id").agg(F.min("h1").alias("stays"))
    found = found.join(stays, "class_id").where("doc_id <> class_id or h1 <> stays or n > 1")
    found = cut(found.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), (F.expr("doc_id = class_id and h1 = stays")).alias("_again")))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(text_of()) == F.col("_h1"))
    left = docs.join(small(found, 200_000), same, "left_anti")
    again = cut(found.where("_again"))
    if again.isEmpty():
        return left
    more = docs.join(small(again), same, "left_semi").withColumn("_h1", F.xxhash64(text_of())).dropDuplicates(["doc_id", "_h1"])
    return left.unionByName(more.drop("_h1"))
