"""The registered queries of the ten operators, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, bpe, chat, line_dedup, mixing, near_dup, quality, substring, topk, warc
from .common import cut, discard, scratch, table

#: Where op5 finds the vocabulary; None: the installed public tokenizers.
BPE_RANKS: str | None = None


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by passages shared with others."""
    return substring.classes(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the queries (vec_id divisible by 100): its 10 highest integer inner products."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC archives, converted to WARC, and read back."""
    arc, out = scratch(spark, "arc"), scratch(spark, "warc")
    warc.pages_to_arc(table(spark, sf_dir, "pages"), arc)
    warc.convert_archives(spark, arc, out)
    discard(spark, arc)
    read = cut(warc.warc_pages(spark, out))
    discard(spark, out)
    named = read.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page")).distinct()
    x = read.join(named, F.when(F.col("record_type") == "revisit", F.col("refers_to_id")) == F.col("_id"), "left")
    return x.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to"), F.col("ok").alias("intact"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: what it takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def bpe_vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """Rank file and pattern. path: of a rank file; else BPE_RANKS, else the installed one."""
    import public_tokenizers

    with open(path or BPE_RANKS or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every text, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe_vocabulary())


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.with_loss_mask(chat.format_conversations(rows.unionByName(own))))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document, and whether the document stays for it."""
    x = near_dup.classes(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, the bounds of its language, and the decision."""
    x = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return x.select("doc_id", "lang", "perplexity", "low", "high", "kept")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that other lines stand for."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the queries (vec_id divisible by 50): its 5 nearest found by cosine."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring, op2_topk, op3_warc, op4_mixing, op5_bpe, op6_chat, op7_minhash, op8_quality, op9_lines, op10_ann)}


#: SQL that DuckDB runs; queries without an entry are tested against brute force.
OP2_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to, true AS intact
FROM k
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_warc": OP3_SQL}
