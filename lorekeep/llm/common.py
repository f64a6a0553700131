"""What the operators of this subpackage share: tables, shared storage, size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: A side of a join is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 20_000


#: The operator that last asked for it, and what a worker process keeps for it from task to task.
_kept: tuple[str, dict] = ("", {})


def keeps(owner: str) -> dict:
    """What this worker process keeps for an operator. Workers are used again by all stages of a pipeline, so what another
    operator kept goes first, and its memory back to the system."""
    global _kept
    if _kept[0] != owner:
        _kept = (owner, {})
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # another C library
            pass
    return _kept[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where the session names
    none (local tests) a folder of our own is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="lorekeep-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table or archive in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lorekeep/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder: computed once, and safe from lost executors."""
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    out._counted = seen.get["n"]
    runtime = df.sparkSession.sparkContext._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        release(df.sparkSession)  # else the driver's heap grows to its limit by garbage
    return out


def counted(df: DataFrame) -> int:
    """The rows of a frame that cut() gave."""
    return df._counted


def few_parts(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """A frame of narrow rows that cut() gave, in no more partitions than so many rows each take: what follows on a small
    frame then has few tasks and files."""
    out = df.coalesce(1 + counted(df) // rows)
    out._counted = counted(df)
    return out


def release(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints of frames no longer in use. Spark removes them when the driver happens to
    collect its garbage, which loops of many small jobs do not wait for. Then the driver's unused memory goes back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Have the driver's JVM return what it has freed outside its heap (compiler, code, networking), which hundreds of
    small jobs leave in the allocator of each thread. False where the JVM has no such command."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
        given = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", new(jvm.Object, 0), new(jvm.String, 0)]
        types, values = new(jvm.Class, 4), new(jvm.Object, 4)
        for i in range(4):
            types[i], values[i] = jvm.Class.forName(kinds[i]), given[i]
        # by the interface, as the server's own class is not open to reflection
        invoke = jvm.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path made by scratch()."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (already cut), with a broadcast hint if it was counted to be small; else as it is, for a shuffled join."""
    n = getattr(df, "_counted", None)
    if n is None:
        n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
