"""Vector functions and embedders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Turns texts into vectors, a batch at a time.
Embedder = Callable[[list[str]], list[list[float]]]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, kept within [0, 1]; null for a zero or null vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size)))


def axis_vector(text: Column, axes: list[str]) -> Column:
    """A deterministic embedding: 1 where the text holds an axis, else 0.01, of unit length."""
    raw = F.array(*[F.when(F.contains(F.lower(text), F.lit(a)), 1.0).otherwise(0.01) for a in axes])
    return F.element_at(F.transform(F.array(raw), lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))), 1)


def hash_embedder(width: int = 64) -> Embedder:
    """Signed counts of hashed words: works offline."""
    import math
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * width
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % width] += 1.0 if h >> 31 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def embedded(df: DataFrame, text: str, embed: Embedder, name: str = "embedding") -> DataFrame:
    """df with a vector for its text column, computed once a row in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(embed(p.fillna("").tolist()))

    return df.withColumn(name, run.asNondeterministic()(F.col(text)))


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id, similarity of the k vectors (id, embedding) most similar to one query; ties to the smaller id."""
    x = vectors.select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(v)) for v in query])).alias("similarity")).where("similarity is not null")
    return x.orderBy(F.col("similarity").desc(), "id").limit(k)


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1_024) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest vectors (id, embedding) of each query (query_id, q); ties to the
    smaller id. Queries go in blocks of about `block`, one of which is sent to the tasks at a time; each task scores its
    vectors as matrices and keeps its own k, so that few rows a query are exchanged. Zero and null vectors take no part."""
    spark = queries.sparkSession
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, similarity double"
    asked = queries.where("q is not null").select("query_id", F.col("q").cast("array<double>").alias("q"))
    blocks = -(-asked.count() // block)
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if rows:
            ids, q = [r.query_id for r in rows], _unit(np.array([r.q for r in rows], np.float64))
            found.append(vectors.select("id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null").mapInArrow(_best_of(pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType)), q, k), kinds))
    if not found:
        return spark.createDataFrame([], kinds + ", rank int")
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)


def _best_of(query_ids: pa.Array, q: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            batch = pa.Table.from_batches([batch]).sort_by("id").combine_chunks()
            if not batch.num_rows:
                continue
            v = batch.column("v").combine_chunks()
            x = _unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1))
            s = np.zeros((len(q), len(x)))
            for j in range(x.shape[1]):  # column by column: the same sum for equal vectors wherever they stand
                s += q[:, j, None] * x[None, :, j]
            s = np.where(np.isnan(s), -1.0, np.clip(s, 0.0, 1.0))
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            n, at = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
            real = s[n, at] >= 0
            n, at = n[real], at[real]
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(n)), batch.column("id").combine_chunks().take(pa.array(at)), pa.array(s[n, at])], names=["query_id", "id", "similarity"])

    return run
