"""The watcher: a timer stream that mines transcripts changed of late.

A file stream would see a known path once; sessions grow. So a rate stream sets the pace, and each micro-batch lists the files changed within two intervals, which the store's hashes and bookmarks make safe to repeat."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import Embedder
from ..operators.extract import Generator, Result, extract
from ..operators.store import Store
from ..settings import Settings
from ..sources.transcripts import discover, parser, session_of, working_dirs

log = logging.getLogger(__name__)
#: Transcripts to a pass.
BATCH = 200


def active(sources: list[dict]) -> list[dict]:
    """Sources whose format has a parser."""
    for s in sources:
        if parser(s["format"]) is None:
            log.warning("no parser for %s; %s is skipped", s["format"], s["root"])
    return [s for s in sources if parser(s["format"]) is not None]


def mine(store: Store, source: dict, embed: Embedder, generate: Generator, since: float | None, settings: Settings, key_of=lambda cwd: cwd) -> list[Result]:
    """One pass over a source, in batches by path."""
    files = discover(store.spark, source["root"], source["glob"], since)
    paths = [r.path for r in files.select("path").orderBy("path").collect()]
    out = []
    for at in range(0, len(paths), BATCH):
        part = files.where(F.col("path").isin(paths[at : at + BATCH])).persist()
        cwd = {r.path: key_of(r.cwd) for r in working_dirs(part).collect()}
        stems = {r.path: r.s for r in part.select("path", session_of(F.col("path")).alias("s")).collect()}
        out += extract(store, part, embed, generate, kind=source["format"], harness=source["harness"], projects=cwd, sessions=stems, settings=settings)
        part.unpersist()
    return out


def start(store: Store, embed: Embedder, generate: Generator, settings: Settings, checkpoint: str) -> StreamingQuery | None:
    """Start watching; None if the interval is 0 or less. A source that fails does not stop the others."""
    if settings.watch_interval <= 0:
        return None
    sources = active(settings.watch_sources)

    def batch(_: DataFrame, epoch: int) -> None:
        for s in sources:
            try:
                mine(store, s, embed, generate, time.time() - 2 * settings.watch_interval, settings)
            except Exception:  # noqa: BLE001
                log.exception("mining %s failed", s["root"])

    ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{settings.watch_interval} seconds").start()
