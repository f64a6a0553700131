"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order; each partition posts its vectors in
inverted files, one per pivot, with the pivot's place in the vector's order. A query reads the files of its own nearest pivots and sums, per
posted vector, how far each shared pivot's place differs; a pivot missing from a prefix counts as the place after it. That is the footrule distance of the
two prefixes. The vectors nearest by it are scored exactly on the original vectors. Every row is indexed; each partition reranks its own share.

Bounds: PIVOTS pivots from a sample of SAMPLE rows (smallest hashes of the id), prefix PREFIX, and of a partition's vectors the SHARE nearest by footrule, FLOOR at least,
are reranked. Measured recall is in the README.

Edge cases: see blocks.py; zero vectors take no part. Fewer than k candidates give all of them. An empty table gives no rows. Extra columns do not take part.
Where a partition has at most FLOOR vectors all of them are reranked. Copies of one vector have exactly the same score, so that ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .blocks import arrays, fitted, matrix, query_blocks, usable
from .common import cut

PIVOTS, SAMPLE, PREFIX, SHARE, FLOOR = 128, 1_024, 48, 0.15, 512
#: Vectors of one inverted file set; a partition with more has several.
SHARD = 16_384


def cosine_rows(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q, summed column by column in doubles: the same for equal rows wherever they stand."""
    dot, xx, qq = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for j in range(x.shape[1]):
        dot += x[:, j] * q[j]
        xx += x[:, j] * x[:, j]
        qq += q[j] * q[j]
    return dot / (np.sqrt(xx) * np.sqrt(qq))


def pick_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from each other, of the sample: greedily the one least similar to those picked. Unit length."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample).collect()
    x = matrix([r.v for r in rows])
    if not len(x):
        return x
    x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(pivots, len(x)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Row by row the nearest pivots, nearest first."""
    near = fitted(x, pivots.shape[1]) @ pivots.T
    prefix = min(prefix, len(pivots))
    top = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    by = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, by, 1)


class Inverted:
    """Inverted files of one shard."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, prefix: int):
        order = orders(x, pivots, prefix)
        self.prefix = order.shape[1]
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by], np.arange(len(pivots) + 1))
        self.rows, self.places = by // self.prefix, by % self.prefix
        self.n = len(x)

    def nearest(self, order: np.ndarray, most: int) -> np.ndarray:
        """Rows nearest to a query of this order by footrule, `most` of them."""
        # a pivot that only one of both has counts as if at place `prefix` in the other
        gain = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(order):
            files = slice(self.starts[pivot], self.starts[pivot + 1])
            there = self.places[files]
            gain[self.rows[files]] += (self.prefix - place) + (self.prefix - there) - np.abs(place - there)
        # footrule = constant - gain
        if most >= self.n:
            return np.arange(self.n)
        return np.argpartition(-gain, most - 1)[:most]


def _search(qids, q, pivots, k, prefix, share, floor):
    def run(batches):
        asked = orders(q, pivots, prefix)
        for ids, x in _shards(batches):
            files = Inverted(x, pivots, prefix)
            x = fitted(x, max(x.shape[1], q.shape[1]))
            out = []
            most = max(floor, int(share * len(ids)) + 1)
            for n, (qid, order) in enumerate(zip(qids, asked, strict=True)):
                rows = files.nearest(order, most)
                rows = rows[ids[rows] != qid]
                s = cosine_rows(x[rows], fitted(q[n : n + 1], x.shape[1])[0])
                best = np.lexsort((ids[rows], -s))[:k]
                out.append((np.full(len(best), qid), ids[rows][best], s[best]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([y[i] for y in out])) for i in range(3)], names=["query_id", "vec_id", "score"])

    return run


def _shards(batches):
    ids, xs, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        i, x = arrays(batch)
        ids.append(i)
        xs.append(x)
        n += len(i)
        if n >= SHARD:
            yield _joined(ids, xs)
            ids, xs, n = [], [], 0
    if n:
        yield _joined(ids, xs)


def _joined(ids, xs):
    width = max(x.shape[1] for x in xs)
    return np.concatenate(ids), np.concatenate([fitted(x, width) for x in xs])


def search(df: DataFrame, chosen: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 2_048, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, floor: int = FLOOR) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by cosine. chosen: a condition on column id that tells the queries."""
    vectors = usable(df, id_col, vector_col, nonzero=True)
    centres = pick_pivots(vectors, pivots)
    found = []
    for qids, q in query_blocks(vectors, chosen, block):
        found.append(vectors.mapInArrow(_search(qids, q, centres, k, prefix, share, floor), "query_id long, vec_id long, score double"))
        if len(found) >= 8:
            found = [cut(reduce(DataFrame.unionByName, found))]
    if not found:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
