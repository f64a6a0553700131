"""Mixing sources to target weights, by Sainte-Lague apportionment. DataFrame functions only.

The words of the corpus are shared out among the sources by weight. Each source's target becomes a whole
number of equal blocks by the highest quotients target/1, target/3, target/5, ...; each source's blocks are
apportioned the same way among its shards (hash ranges of its documents), which splits a hot source. Inside a
shard the documents stand in a seeded order and their words form one ring that is cut into blocks; the shard
takes the whole ring as often as its quota allows and then a run of consecutive blocks from a seeded block on,
so that nearly all documents are taken whole. The last block of a source is trimmed to meet its target.

Edge cases. A null text, an empty text and a text of white space have size 0 and are taken 0 times. A null
source is a source of its own, the last in order. Repeated rows are separate rows, each with its own share.
An empty table gives an empty result. Extra columns do not take part. The result depends on ids, sources,
sizes and the seed alone, not on partitions, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, small, text_of

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]*"


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(per_source: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """Per source, in code-point order with null last: its weight and target. per_source: source, source_size.

    Targets share the total by weight; a target stops at cap times its source's size and the excess goes to the
    others by weight. That is water filling: with the sources sorted by cap/weight, the level is the first one
    that the next source can hold. One row per source meets in one task here; rows of documents never do."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    x = per_source.withColumn("place", F.row_number().over(in_order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    x = x.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    x = x.withColumn("level", left / weight_left)
    x = x.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"])
    return x.select("source", "source_size", "place", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def apportion(df: DataFrame, votes: str, seats: Column, order: list[str], group: list[str]) -> DataFrame:
    """Sainte-Lague: df with column quota, the seats of each row within its group (columns group).

    The seats go to the highest quotients votes/(2k-1). With n rows and V votes, the last seat's quotient is known
    within bounds, V/(seats+n/2) and V/(seats-n/2) halved; seats above the upper bound are given at once, and only those
    between the bounds (about 2n in all) are ranked. Ties go to the earlier row by order."""
    w = Window.partitionBy(*group)
    x = df.withColumn("_seats", seats.cast("double")).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_v", F.sum(F.col(votes).cast("double")).over(w))
    part = F.when(F.col("_v") > 0, F.col(votes) / F.col("_v")).otherwise(F.lit(0.0))
    x = x.withColumn("_lo", F.greatest(F.lit(0), F.floor(part * (F.col("_seats") - F.col("_n") / 2) + 0.5) - 1).cast("long"))
    x = x.withColumn("_hi", F.when(part > 0, F.floor(part * (F.col("_seats") + F.col("_n") / 2) + 0.5) + 1).otherwise(F.col("_lo")).cast("long"))
    x = x.withColumn("_need", F.col("_seats") - F.sum("_lo").over(w))
    keys = [*dict.fromkeys([*group, *order])]
    ranked = x.where("_hi > _lo and _need > 0").select(*keys, votes, "_need", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_k"))
    by_quotient = Window.partitionBy(*group).orderBy((F.col(votes) / (2 * F.col("_k") - 1)).desc(), *order, "_k")
    won = ranked.withColumn("_r", F.row_number().over(by_quotient)).where("_r <= _need").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    renamed = won.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_won")
    on = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
    full = x.join(renamed, on, "left")
    return full.withColumn("quota", F.col("_lo") + F.coalesce(F.col("_won"), F.lit(0))).drop("_seats", "_n", "_v", "_lo", "_hi", "_need", "_won", *[f"_w_{k}" for k in keys])


def plan(sized: DataFrame, *, weights=(1, 2, 3), cap: int = 3, block: int = 64, shard_words: int = 65_536, max_shards: int = 8_192, seed: int = 17) -> DataFrame:
    """What the mix takes of each row. sized: id, source, size, mark (anything that tells rows of one id apart).

    Returns id, source, size, mark, source_size, target, taken, and how: `times` whole passes, then the words [from1, to1) and
    [from2, to2) of the row (equal bounds: none). block: words to a block, less where the corpus has under 1024
    blocks a source. shard_words: words to a shard, more where that would give over max_shards shards."""
    rows = cut(sized.groupBy("id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("copies")))
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = targets(per_source, weights, cap).withColumn("_all", F.sum("source_size").over(Window.partitionBy())).withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy()))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("_all") / F.col("_count") / 1024))).cast("long"))
    sources = apportion(sources, "target", F.round(F.col("_all") / F.col("block")), ["place"], [])
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.greatest(F.lit(float(shard_words)), F.col("_all") / max_shards))).cast("long"))
    sources = cut(sources.select(F.col("source").alias("_source"), "source_size", "target", "block", F.col("quota").alias("source_quota"), "shards", (F.col("target") >= cap * F.col("source_size")).alias("all_of_it")))
    x = rows.join(small(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    x = x.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id", "size", "mark"), F.col("shards")))
    once = Window.partitionBy("source")
    shards = x.groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), *[F.first(c).alias(c) for c in ("target", "block", "source_quota", "all_of_it")])
    shards = apportion(shards, "words", F.col("source_quota"), ["shard"], ["source"])
    trim = F.when(F.row_number().over(once.orderBy(F.col("words").desc(), "shard")) == 1, F.round("target") - F.col("source_quota") * F.col("block")).otherwise(0)
    quota = F.when(F.col("all_of_it"), cap * F.col("words")).otherwise(F.least(cap * F.col("words"), F.greatest(F.lit(0), F.col("quota") * F.col("block") + trim)))
    shards = shards.withColumn("take", quota.cast("long")).withColumn("passes", F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0).cast("long"))
    shards = shards.withColumn("run", F.col("take") - F.col("passes") * F.col("words"))
    shards = shards.withColumn("start", F.col("block") * F.pmod(F.xxhash64(F.lit(seed + 1), "source", "shard"), F.greatest(F.lit(1), F.floor(F.col("words") / F.col("block")))))
    shards = cut(shards.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "words", "passes", "run", "start"))
    x = x.join(small(shards), F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    seeded = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 2), "id", "size", "mark"), "id", "size", "mark")
    x = x.withColumn("at", F.sum(F.col("size") * F.col("copies")).over(seeded.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("copies"))
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    within = lambda c: F.greatest(F.lit(0), F.least(F.col("size"), c - F.col("at")))  # noqa: E731  a place on the ring, as a word of the row
    end = F.col("start") + F.col("run")
    x = x.withColumn("from1", within(F.col("start"))).withColumn("to1", within(F.least(end, F.col("words"))))
    x = x.withColumn("from2", F.lit(0).cast("long")).withColumn("to2", within(F.greatest(F.lit(0), end - F.col("words"))))
    x = x.withColumn("taken", F.col("passes") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2"))
    return x.select("id", "source", "size", "mark", "copy", "source_size", "target", "taken", F.col("passes").alias("times"), "from1", "to1", "from2", "to2")


def mix(docs: DataFrame, **knobs) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of docs (doc_id, source, text)."""
    sized = docs.select(F.col("doc_id").alias("id"), "source", size_of(F.col("text")).alias("size"), F.lit(0).alias("mark"))
    return plan(sized, **knobs).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **knobs) -> DataFrame:
    """The mix itself: the rows of docs with the words taken, repeats in full passes first. Rows of which nothing is taken go;
    text and n_chars follow what is taken, the other columns stay."""
    source = docs.withColumn("_size", size_of(F.col("text"))).withColumn("_mark", F.xxhash64(text_of()))
    takes = plan(source.select(F.col("doc_id").alias("id"), "source", F.col("_size").alias("size"), F.col("_mark").alias("mark")), **knobs).where("taken > 0")
    takes = takes.select(F.col("id").alias("_id"), F.col("source").alias("_src"), F.col("size").alias("_s"), F.col("mark").alias("_m"), "copy", "times", "from1", "to1", "from2", "to2")
    each = Window.partitionBy("doc_id", "source", "_size", "_mark").orderBy(F.lit(0))
    x = source.withColumn("_copy", F.row_number().over(each) - 1)
    x = x.join(takes, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_s")) & (F.col("_mark") == F.col("_m")) & (F.col("_copy") == F.col("copy")))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"{WORD}{SPACE}"), F.lit(0))
    piece = lambda a, b: F.when((F.col(a) == 0) & (F.col(b) == F.col("_size")), F.array("text")).when(F.col(b) > F.col(a), F.array(F.array_join(F.slice(words, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(F.array_repeat("text", F.col("times").cast("int")), piece("from1", "to1"), piece("from2", "to2")), "\n")
    out = x.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
