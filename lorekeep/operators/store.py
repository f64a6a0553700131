"""The store: an append-only change log in Parquet, and the state folded from it.

Every mutation appends events in one write, so that it happens whole or not at all. Each directory has one writer, which numbers the events. Folding groups by entity: an entity exists if it was added and not deleted since;
status, confidence, retrievals and vectors follow from its events in order."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import BOOKMARKS, EVENT
from ..settings import CATEGORIES, REINFORCE_CAP, REINFORCE_STEP, SCOPES, STATUSES


def fold_memories(events: DataFrame) -> DataFrame:
    """The memories that exist after all events. What happens to an id before its last add, in an earlier life or in
    none, has no effect on it."""
    at = F.col("seq")
    kind = F.col("action")
    lives = events.where(kind.isin("add", "forget")).groupBy("entity_id")
    lives = lives.agg(
        F.max_by("memory", F.when(kind == "add", at)).alias("m"),
        F.max(F.when(kind == "add", at)).alias("added"),
        F.max(F.when(kind == "forget", at)).alias("gone"),
    )
    lives = lives.where(F.col("added").isNotNull() & (F.coalesce("gone", F.lit(-1)) < F.col("added")))
    since = events.join(lives.select("entity_id", "added"), "entity_id").where(at > F.col("added"))
    status = F.when(F.startswith("action", F.lit("status:")), at)
    since = since.groupBy("entity_id").agg(
        F.max_by(F.substring("action", 8, 100), status).alias("status"),
        F.count_if(kind == "reinforce").cast("int").alias("n"),
        F.count_if(kind == "retrieve").alias("seen"),
        F.max(F.when(kind == "retrieve", F.col("ts"))).alias("last"),
    )
    x = lives.join(since, "entity_id", "left")
    # step by step, as repeated updates would; a closed form differs in the last bit
    start, steps = F.col("m.confidence"), F.sequence(F.lit(1), F.col("n"))
    raised = F.aggregate(steps, start, lambda a, _: F.least(F.lit(REINFORCE_CAP), a + F.lit(REINFORCE_STEP)))
    now = {
        "status": F.coalesce("status", F.col("m.status")),
        "confidence": F.when(F.col("n") > 0, raised).otherwise(start),
        "last_retrieved": F.coalesce("last", F.col("m.last_retrieved")),
        "times_retrieved": F.coalesce("m.times_retrieved", F.lit(0)) + F.coalesce("seen", F.lit(0)),
    }
    return x.select(*[now.get(f.name, F.col(f"m.{f.name}")).alias(f.name) for f in x.schema["m"].dataType])


def fold_episodes(events: DataFrame) -> DataFrame:
    of = lambda action: F.when(F.col("action") == action, F.col("seq"))
    x = events.groupBy("entity_id").agg(F.max_by("episode", of("add_episode")).alias("e"), F.max(of("add_episode")).alias("added"), F.max(of("rollback_episode")).alias("gone"))
    return x.where(F.col("added").isNotNull() & (F.coalesce("gone", F.lit(-1)) < F.col("added"))).select("e.*")


def fold_vectors(events: DataFrame) -> DataFrame:
    """id, embedding: the last vector of each entity that has one and is not deleted."""
    deleted = F.col("action").isin("forget", "rollback_episode")
    x = events.groupBy("entity_id").agg(F.max_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("seq"))).alias("embedding"), F.max(F.when(F.col("embedding").isNotNull(), F.col("seq"))).alias("at"), F.max(F.when(deleted, F.col("seq"))).alias("gone"))
    return x.where(F.col("embedding").isNotNull() & (F.coalesce("gone", F.lit(-1)) < F.col("at"))).select(F.col("entity_id").alias("id"), "embedding")


def listed(memories: DataFrame, scope_type: str | None = None, scope_key: str | None = None, status: str | None = None) -> DataFrame:
    for name, value in (("scope_type", scope_type), ("scope_key", scope_key), ("status", status)):
        if value is not None:
            memories = memories.where(F.col(name) == value)
    return memories.orderBy("created_at", "id")


def listed_episodes(episodes: DataFrame, scope_type: str | None = None, scope_key: str | None = None, limit: int | None = None) -> DataFrame:
    for name, value in (("scope_type", scope_type), ("scope_key", scope_key)):
        if value is not None:
            episodes = episodes.where(F.col(name) == value)
    x = episodes.orderBy(F.col("created_at").desc(), "id")
    return x if limit is None else x.limit(limit)


class Store:
    def __init__(self, spark: SparkSession, path: str, scrub_forgotten: bool = False):
        self.spark, self.path, self.scrub = spark, path.rstrip("/"), scrub_forgotten
        self._next: int | None = None

    @staticmethod
    def now() -> str:
        return datetime.now(timezone.utc).isoformat()

    def _table(self, name: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        # columns that older files lack come up as nulls
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._table("events", EVENT)

    def append(self, rows: list[dict]) -> None:
        """Append events (action, entity_id, ...), numbered in order, as one write."""
        if not rows:
            return
        if self._next is None:
            self._next = (self.events().agg(F.max("seq")).first()[0] or 0) + 1
        names = ["seq", "ts", "action", "entity_id", "detail", "memory", "episode", "embedding"]
        ts = self.now()
        full = [tuple({"ts": ts, **r, "seq": self._next + i}.get(n) for n in names) for i, r in enumerate(rows)]
        self.spark.createDataFrame(full, EVENT).coalesce(1).write.mode("append").parquet(f"{self.path}/events")
        self._next += len(rows)

    # memories
    def memory_event(self, embedding: list[float] | None = None, **fields) -> dict:
        m = {"id": "", "category": "fact", "scope_type": "user", "scope_key": "*", "status": "proposed", "confidence": 1.0, "times_retrieved": 0, "times_used": 0} | fields
        if m["category"] not in CATEGORIES or m["scope_type"] not in SCOPES or m["status"] not in STATUSES:
            raise ValueError("category, scope_type or status is not one of the allowed values")
        m["id"] = m["id"] or f"mem_{uuid.uuid4().hex[:12]}"
        m["created_at"] = m.get("created_at") or self.now()
        return {"action": "add", "entity_id": m["id"], "detail": m["content"], "memory": m, "embedding": embedding}

    def add(self, **fields) -> dict:
        e = self.memory_event(**fields)
        self.append([e])
        return e["memory"]

    def memories(self) -> DataFrame:
        return fold_memories(self.events())

    def vectors(self) -> DataFrame:
        return fold_vectors(self.events().where(F.col("action").isin("add", "forget")))

    def episode_vectors(self) -> DataFrame:
        return fold_vectors(self.events().where(F.col("action").isin("add_episode", "rollback_episode")))

    def get(self, memory_id: str) -> dict | None:
        row = fold_memories(self.events().where(F.col("entity_id") == memory_id)).first()
        return row.asDict() if row else None

    def record_retrieval(self, ids: list[str]) -> None:
        ts = self.now()
        self.append([{"action": "retrieve", "entity_id": i, "ts": ts} for i in ids])

    def set_status(self, memory_id: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"no status {status}")
        self.append([{"action": f"status:{status}", "entity_id": memory_id}])

    def reinforce(self, memory_id: str, session: str | None = None) -> None:
        self.append([{"action": "reinforce", "entity_id": memory_id, "detail": session}])

    def forget(self, memory_id: str) -> bool:
        if self.get(memory_id) is None:
            return False
        self.append([{"action": "forget", "entity_id": memory_id}])
        return True

    # episodes
    def episode_event(self, embedding: list[float] | None = None, **fields) -> dict:
        e = {"id": "", "scope_type": "user", "scope_key": "*"} | fields
        if e["scope_type"] not in SCOPES:
            raise ValueError("scope_type is not one of the allowed values")
        e["id"] = e["id"] or f"ep_{uuid.uuid4().hex[:12]}"
        e["created_at"] = e.get("created_at") or self.now()
        return {"action": "add_episode", "entity_id": e["id"], "detail": e.get("session_id"), "episode": e, "embedding": embedding}

    def add_episode(self, **fields) -> dict:
        e = self.episode_event(**fields)
        self.append([e])
        return e["episode"]

    def delete_episode(self, episode_id: str) -> None:
        self.append([{"action": "rollback_episode", "entity_id": episode_id}])

    def episodes(self) -> DataFrame:
        return fold_episodes(self.events())

    # log of changes, and of transcripts
    def audit(self) -> DataFrame:
        """seq, ts, action, entity_id, detail in order; with scrub_forgotten, without the contents of what was forgotten."""
        x = self.events().select("seq", "ts", "action", "entity_id", "detail")
        if self.scrub:
            gone = x.where("action = 'forget'").select("entity_id").distinct().withColumn("_gone", F.lit(True))
            x = x.join(gone, "entity_id", "left").withColumn("detail", F.when(F.col("_gone"), None).otherwise(F.col("detail"))).drop("_gone")
        return x.select("seq", "ts", "action", "entity_id", "detail").orderBy("seq")

    def bookmarks(self) -> DataFrame:
        """path, hash, turns: the last state of each transcript."""
        x = self._table("bookmarks", BOOKMARKS).groupBy("path").agg(F.max_by(F.struct("hash", "turns"), "seq").alias("b"))
        return x.select("path", "b.hash", F.coalesce("b.turns", F.lit(0)).alias("turns"))

    def mark(self, rows: list[tuple[str, str, int]]) -> None:
        if rows:
            at = datetime.now(timezone.utc).timestamp()
            self.spark.createDataFrame([(int(at * 1e6) + i, *r) for i, r in enumerate(rows)], BOOKMARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/bookmarks")
