"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and language-specific bounds on perplexity.

The model is over characters, of order five. Characters up to U+07FF are themselves, others share 2048 hashed classes, so that an n-gram is one 64-bit number of 12 bits a character; each
text starts after four start marks. Trusted documents are those that all their labels call good and not toxic; a fifth of them, by a hash of the id, is held out of the counts. Every trusted text is counted
whole: each task adds up its own n-grams and the counts are summed by a shuffle on the n-gram. The Kneser-Ney tables (continuation counts, discounts D1, D2, D3+ per order, interpolation weights per context) are joins and aggregations on n-grams.

Scoring: where the model has at most BROADCAST_GRAMS n-grams, which is counted first, it is broadcast and documents are scored where they lie. A larger model stays sharded: each document's distinct n-grams with their counts are
joined with the tables by n-gram, and the logarithms are summed per document.

Decision: a document stays if its perplexity is within the LOW and HIGH quantiles of the held-out trusted documents of its language, widened by MARGIN of their logarithmic distance from the median; a language with fewer than LEAST held-out documents uses those of all languages.
Both sides count: text of repeated words is as odd as text of symbols.

Edge cases. Null and empty texts have no perplexity and go. A null language is a language of its own. Without held-out trusted documents every document with text stays. A null doc_id is never labelled, and is scored like others.
Rows with one id and different texts are judged one by one. Repeated rows are all returned. Empty tables give no rows. Extra columns do not take part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, keeps, small, text_of

ORDER, BITS = 5, 12
BROADCAST_GRAMS = 4_000_000
LOW, HIGH, MARGIN, LEAST = 0.005, 0.995, 0.15, 30
_MASK = (1 << BITS) - 1
#: Characters handled at once.
PART = 2 << 20
_START = "\x02" * (ORDER - 1)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Order-5 n-grams of all characters of the texts, one after the other, and where each text begins."""
    cp = np.frombuffer("".join(_START + t for t in texts).encode("utf-32-le"), np.uint32)
    high = cp >= 2048
    if high.any():
        cp = np.where(high, 2048 + (cp * np.uint32(2654435761) >> np.uint32(21)), cp)
    c = cp.astype(np.int64)
    g = np.zeros(max(0, len(c) - ORDER + 1), np.int64)
    for j in range(ORDER):
        g = (g << BITS) | c[j : len(c) - ORDER + 1 + j]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)])[:-1]
    real = np.ones(len(g) + ORDER - 1, bool)  # n-grams that end in a start mark of a later text do not count
    for j in range(ORDER - 1):
        real[begins[1:] - (ORDER - 1) + j] = False
    g = g[real[: len(g)]]
    return g, np.concatenate([[0], np.cumsum(lengths)])


def parts(texts: list[str]):
    """Slices of the texts of about PART characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


class Table:
    """64-bit keys to numbers, by open addressing over arrays."""

    EMPTY = np.int64(-1)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, self.EMPTY)
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == self.EMPTY]
            where, first = np.unique(slot[free], return_index=True)
            self.keys[where], self.values[where] = keys[free[first]], values[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where missing), and whether there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = there == keys
        out = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (there != self.EMPTY))
        while len(left):
            s = slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            there = self.keys[s]
            hit = there == keys[left]
            out[left[hit]] = self.values[s[hit]]
            found[left[hit]] = True
            left = left[~hit & (there != self.EMPTY)]
        return out, found


class Model:
    """Log-probabilities of n-grams, from tables of the n-grams seen and of the weights of contexts."""

    def __init__(self, seen: list[tuple[np.ndarray, np.ndarray]], weights: list[tuple[np.ndarray, np.ndarray]]):
        self.seen, self.weights = [Table(*x) for x in seen], [Table(*x) for x in weights]

    def log_p(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(g), -BITS * np.log(2), np.float32)
        g = g & ((1 << BITS * order) - 1)
        out, found = self.seen[order - 1].get(g)
        miss = np.flatnonzero(~found)
        if len(miss):
            weight, known = self.weights[order - 1].get(g[miss] >> BITS)
            out[miss] = self.log_p(g[miss], order - 1) + np.where(known, weight, np.float32(0))
        return out


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id, held_out of the documents that all labels call good and not toxic."""
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    x = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False)).cast("int")).alias("ok")).where("ok = 1")
    return x.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0).alias("held_out"))


def counts(docs: DataFrame) -> DataFrame:
    """g, c: the order-5 n-grams of all texts."""

    def run(batches):
        keeps("quality")
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            for s in parts(texts):
                g, n = np.unique(codes(texts[s])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "c"])

    return docs.select(text_of().alias("text")).where("text <> ''").mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(types: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts (Chen and Goodman)."""
    n = types.agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    bounded = lambda i, a, b: min(float(i), max(0.0, i - (i + 1) * y * b / a)) if a else 0.5 * i
    return bounded(1, n1, n2), bounded(2, n2, n3), bounded(3, n3, n4)


def kneser_ney(grams: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order 1 to 5: (g, p) of the n-grams seen, interpolated probabilities; (ctx, weight) of their contexts. grams: g, c of order 5."""
    types = [grams]
    for order in range(ORDER - 1, 0, -1):  # below the highest order a count is the number of different characters before
        types.insert(0, cut(types[0].groupBy(F.col("g").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("g")).agg(F.count(F.lit(1)).alias("c"))))
    out, lower = [], None
    for order, t in enumerate(types, 1):
        d = discounts(t)
        t = t.withColumn("ctx", F.shiftright("g", BITS))
        n = [F.sum(F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).alias("held"), F.sum("c").alias("total")]
        ctx = t.groupBy("ctx").agg(*n).select("ctx", "total", (F.col("held") / F.col("total")).alias("weight"))
        ctx = cut(ctx)
        x = t.join(ctx, "ctx")
        own = (F.col("c") - F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])) / F.col("total")
        if lower is None:
            x = x.select("g", (own + F.col("weight") * F.lit(2.0**-BITS)).alias("p"))
        else:
            x = x.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
            x = x.select("g", (own + F.col("weight") * F.col("q")).alias("p"))
        lower = cut(x)
        out.append((lower, ctx.select("ctx", "weight")))
    return out


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two columns, the second as logarithm."""
    t = df.select(df.columns[0], F.log(df.columns[1]).cast("float").alias("v")).toArrow()
    return t.column(0).to_numpy(), t.column(1).to_numpy()


def perplexities(docs: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """doc_id, lang, mark (a hash of the text), perplexity for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text_of()).alias("mark"), text_of().alias("text"))
    if sum(seen.count() for seen, _ in tables) > BROADCAST_GRAMS:
        return sharded(rows, tables)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(([_collected(s) for s, _ in tables], [_collected(w) for _, w in tables]))
    key = f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}"

    def run(batches):
        models = keeps("quality")
        if key not in models:
            models.clear()
            models[key] = Model(*shared.value)
        model = models[key]
        for batch in batches:
            texts = [t.as_py() for t in batch.column(3)]
            out = np.full(len(texts), np.nan)
            for s in parts(texts):
                g, at = codes(texts[s])
                total = np.concatenate([[0.0], np.cumsum(model.log_p(g), dtype=np.float64)])
                n = np.diff(at)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[s] = np.exp(-(total[at[1:]] - total[at[:-1]]) / n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.float64(), mask=np.isnan(out))], names=["doc_id", "lang", "mark", "perplexity"])

    return rows.mapInArrow(run, "doc_id long, lang string, mark long, perplexity double")


def sharded(rows: DataFrame, tables: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The same by joins: the distinct n-grams of each text meet the tables, shard by shard."""

    def run(batches):
        keeps("quality")
        for batch in batches:
            for i, lang, mark, text in zip(*batch.columns, strict=True):
                g, n = np.unique(codes([text.as_py()])[0], return_counts=True)
                k = len(g)
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * k, x.type) for x in (i, lang, mark)] + [pa.array(g), pa.array(n)], names=["doc_id", "lang", "mark", "g", "n"])

    key = ["doc_id", "lang", "mark"]
    once = rows.dropDuplicates(key)
    x = once.where("text <> ''").mapInArrow(run, "doc_id long, lang string, mark long, g long, n long")
    wanted, logs = cut(x.select("g").distinct()), None
    for order in range(1, ORDER + 1):
        seen, weights = tables[order - 1]
        mask = F.lit((1 << BITS * order) - 1)
        w = wanted.select(F.col("g").bitwiseAND(mask).alias("g")).distinct().withColumn("ctx", F.shiftright("g", BITS))
        w = w.join(seen, "g", "left").join(weights, "ctx", "left")
        if logs is None:
            low = F.lit(-BITS * float(np.log(2)))
        else:
            w = w.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(logs.select(F.col("g").alias("low"), F.col("v").alias("lv")), "low")
            low = F.col("lv")
        logs = cut(w.select("g", F.coalesce(F.log("p"), low + F.coalesce(F.log("weight"), F.lit(0.0))).alias("v")))
    scored = x.join(logs, "g").groupBy(*key).agg(F.exp(-F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("perplexity"))
    same = [rows[k].eqNullSafe(scored[k]) for k in key]
    return rows.join(scored, same, "left").select(*[rows[k] for k in key], "perplexity")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, mark, perplexity, low, high, kept for each row of docs."""
    known = cut(trusted(labels))
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(known.where("not held_out"), 2_000_000), "doc_id", "left_semi")
    tables = kneser_ney(cut(counts(learn)))
    scored = cut(perplexities(docs, tables))
    held = scored.join(small(known.where("held_out"), 2_000_000), "doc_id", "left_semi").where("perplexity is not null").withColumn("x", F.log("perplexity"))
    q = lambda: F.percentile_approx("x", F.array(F.lit(LOW), F.lit(0.5), F.lit(HIGH)), F.lit(10_000))
    bounds = held.groupBy("lang").agg(q().alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select(F.col("lang").alias("_lang"), "q")
    overall = held.agg(q().alias("q_all"))
    x = scored.join(small(cut(bounds)), F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(overall), how="cross")
    x = x.withColumn("q", F.coalesce("q", "q_all"))
    middle, low, high = (F.element_at("q", i) for i in (2, 1, 3))
    x = x.withColumn("low", F.exp(low - MARGIN * (middle - low))).withColumn("high", F.exp(high + MARGIN * (high - middle)))
    kept = F.col("perplexity").isNotNull() & (F.col("q").isNull() | F.col("perplexity").between(F.col("low"), F.col("high")))
    return x.select("doc_id", "lang", "mark", "perplexity", "low", "high", kept.alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    gone = cut(judged(docs, labels).where("not kept").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct())
    return docs.join(small(gone, 500_000), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of()) == F.col("_mark")), "left_anti")
