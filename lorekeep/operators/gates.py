"""Candidate facts: reading a generator's answer, and the gates they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalized
from ..settings import CANDIDATE_SCOPES, CATEGORIES, CONTENT_CHARS, Settings

KEYS = ["content", "category", "scope", "confidence", "evidence_quote"]


def candidate_array(raw: Column) -> Column:
    """The JSON array within an answer as a variant; null if there is none."""
    start = F.instr(raw, "[")
    end = F.length(raw) - F.instr(F.reverse(raw), "]") + 1
    cut = F.when((start > 0) & F.contains(raw, F.lit("]")) & (end > start), F.substr(raw, start, end - start + 1))
    return F.try_parse_json(cut)


def candidates(answers: DataFrame) -> DataFrame:
    """answers (session, raw) -> session, pos and the five fields; items without a key, or whose confidence is no number, drop out. Not-a-number is refused too."""
    items = F.try_variant_get(candidate_array(F.col("raw")), "$", "array<variant>")
    x = answers.select("session", F.posexplode(items).alias("pos", "item"))
    x = x.select("session", "pos", F.try_variant_get("item", "$", "map<string,variant>").alias("m")).where(F.col("m").isNotNull())
    for k in KEYS:
        x = x.where(F.map_contains_key("m", F.lit(k)))
    text = lambda k: F.coalesce(F.try_variant_get(F.element_at("m", k), "$", "string"), F.lit("None"))
    x = x.select("session", "pos", text("content").alias("content"), text("category").alias("category"), text("scope").alias("scope"), F.trim(text("confidence")).try_cast("double").alias("confidence"), text("evidence_quote").alias("evidence_quote"))
    return x.where(F.col("confidence").isNotNull() & ~F.isnan("confidence"))


def gated(found: DataFrame, texts: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Candidates that pass: each gate, then the first of equal contents in a session, then the session's most confident. texts: session, text."""
    s = settings or Settings()
    x = found.join(texts.select("session", normalized(F.col("text")).alias("_text")), "session")
    x = x.where(F.col("category").isin(*CATEGORIES) & F.col("scope").isin(*CANDIDATE_SCOPES) & (F.col("confidence") >= s.confidence_floor) & F.length("content").between(*CONTENT_CHARS))
    x = x.where(F.contains("_text", normalized(F.col("evidence_quote")))).drop("_text")
    same = Window.partitionBy("session", normalized(F.col("content"))).orderBy("pos")
    x = x.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    best = Window.partitionBy("session").orderBy(F.col("confidence").desc(), "pos")
    return x.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.max_per_session)


def grounded(texts: DataFrame, quotes: DataFrame, words: int = 5) -> DataFrame:
    """id, quote_id: the texts (id, text) that hold a quote (quote_id, quote), both normalised once. Words inside a quote
    are whole words of a text that holds it, so a run of them finds the candidates; quotes too short for a run, which is
    counted first, are compared with all texts while they are few."""
    t = texts.select("id", normalized(F.col("text")).alias("_text"))
    q = quotes.select("quote_id", normalized(F.col("quote")).alias("_quote")).where("_quote is not null")
    inside = F.slice(F.split("_quote", " "), 2, words)
    long = F.size(F.split("_quote", " ")) >= words + 2
    t = t.withColumn("_w", F.split("_text", " "))
    at = F.when(F.size("_w") >= words, F.sequence(F.lit(1), F.size("_w") - words + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("_w", i, words))))
    found = t.select("id", F.explode(runs).alias("_run")).join(q.where(long).select("quote_id", F.xxhash64(inside).alias("_run")), "_run")
    found = found.select("id", "quote_id").distinct().join(t.select("id", "_text"), "id").join(q, "quote_id")
    short = q.where(~long)
    if short.limit(1_001).count() <= 1_000:
        short = F.broadcast(short)
    return found.where(F.contains("_text", F.col("_quote"))).select("id", "quote_id").unionByName(
        t.join(short, F.contains("_text", F.col("_quote"))).select("id", "quote_id")
    )
