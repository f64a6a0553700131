"""Transcript sources: finding, hashing and parsing JSON-lines sessions of two formats."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip

# fixed values: where lines end, as str.splitlines has it
LINE_ENDS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def glob_pattern(glob: str) -> str:
    """A regular expression for paths below the root: `**/` any folders, `*` and `?` within a name."""
    parts = re.split(r"(\*\*/|\*|\?)", glob)
    made = {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}
    return "(?:^|/)" + "".join(made.get(p, re.escape(p)) for p in parts) + "$"


def discover(spark: SparkSession, root: str, glob: str = "*.jsonl", since_epoch: float | None = None) -> DataFrame:
    """path, content, hash (MD5 of the bytes), modified of the files below root that match glob, modified at or after
    since_epoch, by path. A root that is not there has none."""
    schema = "path string, content binary, hash string, modified timestamp"
    if not exists(spark, root):
        return spark.createDataFrame([], schema)
    name = glob.rsplit("/", 1)[-1]
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    x = x.select("path", "content", F.md5("content").alias("hash"), F.col("modificationTime").alias("modified"))
    if "/" in glob:
        x = x.where(F.col("path").rlike(glob_pattern(glob)))
    if since_epoch is not None:
        x = x.where(F.col("modified").cast("double") >= since_epoch)
    return x.orderBy("path")


def lines(files: DataFrame) -> DataFrame:
    """path, n, entry: each physical line, as a variant where it is one JSON object."""
    x = files.select("path", F.posexplode(F.split(F.col("content").cast("string"), LINE_ENDS, -1)).alias("n", "line"))
    whole = F.when(F.trim("line").rlike(r"(?s)\A\{.*\}\z"), F.try_parse_json(F.trim("line")))
    return x.select("path", "n", whole.alias("entry"))


def get(v: Column, at: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, at, kind)


def is_text(v: Column, at: str) -> Column:
    return F.startswith(F.schema_of_variant(get(v, at, "variant")), F.lit("STRING"))


def blocks(v: Column, at: str, pick: Callable[[Column], Column]) -> Column:
    """The texts that pick finds in an array of blocks, by single spaces."""
    found = F.transform(get(v, at, "array<variant>"), pick)
    return F.array_join(F.filter(found, lambda t: t.isNotNull() & (t != "")), " ")


def claude_turns(files: DataFrame) -> DataFrame:
    """path, turn_idx, role, text of `claude-jsonl`: user and assistant entries; user strings that begin with `<` are not speech; tools an assistant used are marked."""
    x = lines(files).where(F.col("entry").isNotNull()).withColumn("role", get(F.col("entry"), "$.type")).where(F.col("role").isin("user", "assistant"))
    v = F.col("entry")
    plain = strip(get(v, "$.message.content"))

    def pick(b: Column) -> Column:
        name = F.coalesce(get(b, "$.name"), F.lit("unknown"))
        return F.when((get(b, "$.type") == "text") & is_text(b, "$.text"), strip(get(b, "$.text"))).when((get(b, "$.type") == "tool_use") & (F.col("role") == "assistant"), F.concat(F.lit("[tool: "), name, F.lit("]")))

    said = F.when(is_text(v, "$.message.content"), F.when(~((F.col("role") == "user") & F.startswith(plain, F.lit("<"))), plain)).otherwise(blocks(v, "$.message.content", pick))
    return numbered(x.withColumn("text", said))


def codex_turns(files: DataFrame) -> DataFrame:
    """path, turn_idx, role, text of `codex-jsonl`: message payloads of response items; user text that begins with `<` is not speech."""
    x = lines(files).where(F.col("entry").isNotNull())
    v = F.col("entry")
    x = x.where((get(v, "$.type") == "response_item") & (get(v, "$.payload.type") == "message")).withColumn("role", get(v, "$.payload.role")).where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    pick = lambda b: F.when((get(b, "$.type") == kind) & is_text(b, "$.text"), strip(get(b, "$.text")))
    said = F.when(is_text(v, "$.payload.content"), strip(get(v, "$.payload.content"))).otherwise(blocks(v, "$.payload.content", pick))
    x = x.withColumn("text", said)
    return numbered(x.where(~((F.col("role") == "user") & F.startswith("text", F.lit("<")))))


def numbered(x: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    x = x.where(F.coalesce("text", F.lit("")) != "")
    return x.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1).cast("long").alias("turn_idx"), "role", "text")


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude-jsonl": claude_turns, "codex-jsonl": codex_turns}


def parser(name: str) -> Callable[[DataFrame], DataFrame] | None:
    return PARSERS.get(name)


def working_dirs(files: DataFrame, max_lines: int = 100) -> DataFrame:
    """path, cwd: the first non-empty working directory in each file's first lines."""
    x = lines(files).where((F.col("n") < max_lines) & F.col("entry").isNotNull())
    at = lambda p: F.when(is_text(F.col("entry"), p), F.nullif(get(F.col("entry"), p), F.lit("")))
    x = x.withColumn("cwd", F.coalesce(at("$.cwd"), at("$.payload.cwd"))).where("cwd is not null")
    return x.groupBy("path").agg(F.min_by("cwd", "n").alias("cwd"))


def session_of(path: Column) -> Column:
    """A file's stem."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
