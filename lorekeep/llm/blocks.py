"""Vectors for the search operators: cleaning, query blocks, and Arrow batches as arrays.

A vector takes part if neither it nor its id is null, and no component is null or non-finite. Vectors shorter than others count as padded with zeros.
A query id stands for one query: of rows that repeat an id with different vectors the smallest vector asks. Candidates are all rows,
repeated rows included, but those with the query's own id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """id, v (array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    return x.where(F.exists("v", lambda c: c != 0)) if nonzero else x


def query_blocks(vectors: DataFrame, chosen: Column, block: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The chosen queries as (ids, matrix) blocks of about `block` queries, each fetched when it is asked for: one block at a time is
    on the driver and broadcast, however many queries there are."""
    queries = vectors.where(chosen).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = sorted((r.id, r.v) for r in part.collect())
        if rows:
            yield np.array([r[0] for r in rows], np.int64), matrix([r[1] for r in rows])


def matrix(vectors: list[list[float]], width: int = 0) -> np.ndarray:
    width = max([width, *map(len, vectors)], default=0)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """ids and matrix of a batch (id, v)."""
    ids, v = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == lengths[0]).all():
        return ids, flat.reshape(len(lengths), lengths[0])
    return ids, matrix([x or [] for x in v.to_pylist()])


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """x with `width` columns, padded by zeros or cut (columns that meet zeros alone)."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))
