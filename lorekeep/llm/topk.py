"""Exact top-k search by distributed histogram selection.

Every query scores every vector. The kth largest score of each query is located by histograms: each pass counts scores by bins of
the interval that holds the kth value, the counts of all partitions are added, and the interval shrinks to the bin where the count
from above reaches k. When few scores remain above the lower edge, or the interval is one score wide, the rows at or above the edge are filtered, ties
broken by id, and k kept. A partition reports of its histogram only the uppermost bins that hold k scores, and of the ties at an edge only the k smallest ids, which
loses nothing: the global kth score is never below a partition's own.

Queries go in blocks of bounded size against all rows; only a block and its edges are broadcast. Scores are integers: components are
scaled and floored. Products are summed exactly: in doubles where sums stay below 2^53, in 64-bit integers below 2^62, and in integers
of any size beyond. Scaled components beyond 64 bits are held at their ends, and scores within 2^62 either way.

Edge cases: see blocks.py for vectors that take no part; fewer than k candidates give all of them; an empty table gives no rows; extra columns do not take part.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import arrays, fitted, query_blocks, usable
from .common import cut

#: Scores are held within this either way.
MOST = 2**62 - 1
#: Rows scored at once.
ROWS = 2_048


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows by queries. Integer inner products of float64 matrices that hold integers."""
    x = fitted(x, q.shape[1])
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).sum(axis=1).max(initial=0))
    if most < 2**53:
        return (x @ q.T).astype(np.int64)
    if most < 2**62:
        return x.astype(np.int64) @ q.astype(np.int64).T
    exact = x.astype(object), q.T.astype(object)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(exact[0]) @ whole(exact[1]), -MOST, MOST).astype(np.int64)


def _histogram(qids, q, low, width, bins, k):
    """A task: vectors -> (query's number, bin, count), the uppermost bins with k scores in all."""

    def run(batches):
        total = np.zeros((len(qids), bins + 1), np.int64)  # the last bin: above the interval
        for batch in batches:
            ids, x = arrays(batch)
            for at in range(0, len(ids), ROWS):
                s = _scores(x[at : at + ROWS], q)
                b = np.clip((s - low) // width, -1, bins)
                b[ids[at : at + ROWS, None] == qids[None, :]] = -1
                code = (b + np.arange(len(qids)) * (bins + 1))[b >= 0]
                total += np.bincount(code, minlength=total.size).reshape(total.shape)
        from_above = total[:, ::-1].cumsum(axis=1)[:, ::-1]
        n, b = np.nonzero((total > 0) & (from_above - total < k))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(b, pa.int32()), pa.array(total[n, b])], names=["n", "b", "c"])

    return run


def _filtered(qids, q, low, k):
    """A task: vectors -> (query_id, vec_id, score) at or above the edge; at most k rows a query."""

    def run(batches):
        kept = []
        for batch in batches:
            ids, x = arrays(batch)
            for at in range(0, len(ids), ROWS):
                s, own = _scores(x[at : at + ROWS], q), ids[at : at + ROWS]
                r, n = np.nonzero((s >= low) & (own[:, None] != qids[None, :]))
                kept.append((n, own[r], s[r, n]))
                if sum(len(y[0]) for y in kept) > 4 * k * max(64, len(qids)):
                    kept = [_best(kept, k)]
        if kept:
            n, ids, s = _best(kept, k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[n]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _best(kept, k):
    n, ids, s = (np.concatenate([y[i] for y in kept]) for i in range(3))
    order = np.lexsort((ids, -s, n))
    n, ids, s = n[order], ids[order], s[order]
    first = np.r_[True, n[1:] != n[:-1]] if len(n) else np.zeros(0, bool)
    rank = np.arange(len(n)) - np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
    return n[rank < k], ids[rank < k], s[rank < k]


def top_k(df: DataFrame, chosen: Column, *, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2_048, bins: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score. chosen: a condition on column id that tells the queries."""
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col).select("id", F.transform("v", lambda c: F.floor(F.lit(scale) * c).cast("double")).alias("v"))
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()[0] or 0.0
    found = []
    for qids, q in query_blocks(vectors, chosen, block):
        bound = np.minimum(np.abs(q).sum(axis=1) * most, 2.0**62).astype(np.int64) + 1
        low, high = -bound, bound  # the kth score lies in [low, high)
        above = np.zeros(len(qids), np.int64)
        left = np.full(len(qids), True)
        while left.any():
            width = np.maximum(1, -(-(high - low) // bins))
            part = np.flatnonzero(left)
            counts = vectors.mapInArrow(_histogram(qids[part], q[part], low[part], width[part], bins, k), "n int, b int, c long").groupBy("n", "b").agg(F.sum("c").alias("c"))
            # the edge of each query: the uppermost bin at which the count from above reaches k
            down = Window.partitionBy("n").orderBy(F.col("b").desc())
            edges = counts.withColumn("upto", F.sum("c").over(down)).groupBy("n").agg(F.max(F.when(F.col("upto") >= k, F.struct("b", "upto"))).alias("e"))
            seen = {r.n: r.e for r in edges.collect()}  # a row a query of the block
            for i, at in enumerate(part):
                e = seen.get(i)
                if e is None:  # fewer than k candidates
                    left[at] = False
                    continue
                low[at], high[at] = low[at] + e.b * width[at], low[at] + (e.b + 1) * width[at]
                above[at] = e.upto
                left[at] = above[at] > 4 * k and width[at] > 1
        found.append(vectors.mapInArrow(_filtered(qids, q, low, k), "query_id long, vec_id long, score long"))
        if len(found) >= 8:  # the results of eight blocks are written before more follow
            found = [cut(reduce(DataFrame.unionByName, found))]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
