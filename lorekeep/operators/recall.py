"""Scope, liveness, hybrid recall, conversation recall and briefing.

Nominations come before filters: the nearest are cut first, then those out of scope, archived, superseded or unknown drop out, so that fewer than k may remain. Ties go to the smaller id. Reads change nothing; the caller records retrievals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import first_sentence
from ..functions.vectors import nearest, nearest_each
from ..settings import BRIEFING, KEYWORD_BONUS, KEYWORD_CAP, NOMINATIONS, Settings


def visible(project: str | None) -> Column:
    """User rows always, project rows of this project, shared rows never."""
    own = F.lit(False) if project is None else F.coalesce((F.col("scope_type") == "project") & (F.col("scope_key") == project), F.lit(False))
    return (F.col("scope_type") == "user") | own


def live() -> Column:
    return (F.col("status") != "archived") & (F.coalesce("superseded_by", F.lit("")) == "")


def in_conflict() -> Column:
    return F.coalesce("conflict_with", F.lit("")) != ""


def keyword_bonus(content: Column, query: str) -> Column:
    terms = [t for t in query.lower().split() if len(t) > 3]
    hits = reduce(lambda a, b: a + b, [F.contains(F.lower(content), F.lit(t)).cast("int") for t in terms], F.lit(0))
    return F.least(F.lit(KEYWORD_CAP), F.lit(KEYWORD_BONUS) * hits)


def recency_bonus(created_at: Column, now: str, settings: Settings) -> Column:
    """Halves each half-life; text that is no time with an offset counts as new."""
    ts = F.when(created_at.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(created_at))
    seconds = (F.unix_micros(F.to_timestamp(F.lit(now))) - F.unix_micros(ts)) / 1e6
    days = F.coalesce(F.greatest(F.lit(0.0), seconds / 86400), F.lit(0.0))
    return F.lit(settings.recency_weight) * F.pow(F.lit(0.5), days / settings.recency_halflife_days)


def recall(memories: DataFrame, vectors: DataFrame, query: str, vector: list[float], project: str | None = None, top_k: int | None = None, settings: Settings | None = None) -> DataFrame:
    """The rows of memories with score, best first."""
    k = top_k or (settings or Settings()).top_k
    hits = nearest(vectors, vector, 4 * k)
    x = memories.join(F.broadcast(hits), "id").where(live() & visible(project))
    x = x.withColumn("_s", F.col("similarity") + keyword_bonus(F.col("content"), query)).orderBy(F.col("_s").desc(), F.col("similarity").desc(), "id").limit(k)
    return x.withColumn("score", F.round("_s", 4)).select(*memories.columns, "score")


def recall_episodes(episodes: DataFrame, vectors: DataFrame, vector: list[float], now: str, project: str | None = None, top_k: int = 5, settings: Settings | None = None) -> DataFrame:
    hits = nearest(vectors, vector, NOMINATIONS)
    x = episodes.join(F.broadcast(hits), "id").where(visible(project))
    x = x.withColumn("_s", F.col("similarity") + recency_bonus(F.col("created_at"), now, settings or Settings())).orderBy(F.col("_s").desc(), F.col("similarity").desc(), "id").limit(top_k)
    return x.select("id", "summary", "created_at", "session_id", "scope_type", "scope_key", F.round("_s", 4).alias("score"))


def find_similar(candidates: DataFrame, memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, id, similarity: for each candidate (query_id, q, scope_type, scope_key) the nearest live memory of exactly its scope among the nominations over all scopes."""
    hits = nearest_each(candidates.select("query_id", "q"), vectors, NOMINATIONS)
    kept = memories.where(live()).select("id", F.col("scope_type").alias("_st"), F.col("scope_key").alias("_sk"))
    x = hits.join(kept, "id").join(candidates.select("query_id", "scope_type", "scope_key"), "query_id").where("_st = scope_type and _sk = scope_key")
    first = Window.partitionBy("query_id").orderBy("rank")
    return x.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "id", "similarity")


def decide(candidates: DataFrame, similar: DataFrame, threshold: float = 0.85) -> DataFrame:
    x = candidates.join(similar, "query_id", "left")
    near = F.coalesce(F.col("similarity") >= threshold, F.lit(False))
    return x.select("query_id", F.when(near, "reinforce").otherwise("propose").alias("action"), F.when(near, F.col("id")).alias("id"), "similarity")


def section(memories: DataFrame, name: str, project: str | None = None) -> DataFrame:
    """One section of the briefing: rows with rank and unconfirmed."""
    x = memories.where(live() & visible(project))
    confirmed = F.col("status") == "confirmed"
    newest = [F.col("created_at").desc(), "id"]
    if name == "facts":
        x, order = x.where(confirmed & F.col("category").isin("preference", "fact")), [F.col("times_retrieved").desc(), "created_at", "id"]
    elif name == "decisions":
        x, order = x.where(confirmed & (F.col("category") == "decision")), newest
    elif name == "gotchas":
        x, order = x.where(F.col("category") == "gotcha"), newest
    else:
        x, order = x.where(in_conflict()), ["created_at", "id"]
    if name in BRIEFING:
        x = x.orderBy(*order).limit(BRIEFING[name])
    return x.withColumn("unconfirmed", F.when(F.col("status") == "proposed", True))


def recent(episodes: DataFrame, project: str | None = None) -> DataFrame:
    x = episodes.where(visible(project)).orderBy(F.col("created_at").desc(), "id").limit(BRIEFING["conversations"])
    return x.select("id", first_sentence(F.col("summary")).alias("summary"), "created_at")


def briefing(memories: DataFrame, episodes: DataFrame | None, project: str | None = None) -> DataFrame:
    """section, id, content, created_at, unconfirmed of all five sections (a bag: a memory may be in two)."""
    out = [section(memories, s, project).select(F.lit(s).alias("section"), "id", "content", "created_at", "unconfirmed") for s in ("facts", "decisions", "gotchas", "conflicts")]
    if episodes is not None:
        out.append(recent(episodes, project).select(F.lit("conversations").alias("section"), "id", F.col("summary").alias("content"), "created_at", F.lit(None).cast("boolean").alias("unconfirmed")))
    return reduce(DataFrame.unionByName, out)


def read_episode(episodes: DataFrame, memories: DataFrame) -> DataFrame:
    """Episodes with fact_ids, the ids of memories that came from them, oldest first."""
    facts = memories.where("episode_id is not null").groupBy("episode_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda f: f["id"]).alias("fact_ids"))
    x = episodes.join(facts.withColumnRenamed("episode_id", "_e"), F.col("id") == F.col("_e"), "left").drop("_e")
    return x.withColumn("fact_ids", F.coalesce("fact_ids", F.array().cast(x.schema["fact_ids"].dataType)))
