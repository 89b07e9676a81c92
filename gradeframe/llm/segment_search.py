"""Exact top-k search with multi-resolution segment statistics.

A vector's segments have means and deviations. For two vectors they bound the
distance from below, a few long segments coarsely and many short ones finely;
so they bound the inner product from above. Bounds go from coarse to fine, each
on what the one before left, and exact products are taken of the survivors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.vectors import BLOCK_ROWS, SHARD_ROWS, finite, search

LEVELS = (4, 8, 16, 32)
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and deviations of equal segments, and their length; the end is padded with zeros."""
    length = -(-x.shape[1] // segments)
    parts = np.pad(x, ((0, 0), (0, length * segments - x.shape[1]))).reshape(len(x), segments, length)
    return parts.mean(2), parts.std(2), length


def top_integers(query_ids, q, ids, x, k):
    """Exact best k of one shard for each query; arrays of query id, id and score."""
    levels = []
    norms_q, norms_x = (q * q).sum(1), (x * x).sum(1)
    for segments in LEVELS:
        levels.append((statistics(q, segments), statistics(x, segments)))
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1]
    whole_x = None if largest < _EXACT else [[int(v) for v in row] for row in x]

    def exact(i, rows):
        if whole_x is None:
            return x[rows] @ q[i]
        mine = [int(v) for v in q[i]]
        return np.array([max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(mine, whole_x[r])))) for r in rows],
                        object)

    def bound(i, rows, level):
        """Upper bound of the product: half of both norms less the least squared distance."""
        (mq, dq, length), (mx, dx, _) = level
        least = length * (((mx[rows] - mq[i]) ** 2).sum(1) + ((dx[rows] - dq[i]) ** 2).sum(1))
        return (norms_q[i] + norms_x[rows] - least) / 2

    out = [], [], []
    for i, query_id in enumerate(query_ids):
        rows = np.flatnonzero(ids != query_id)
        if not len(rows):
            continue
        slack = 1e-9 * (norms_q[i] + norms_x[rows]) + 1e-6
        upper = bound(i, rows, levels[0])
        first = rows[np.argpartition(-upper, min(8 * k, len(rows)) - 1)[:8 * k]]
        if len(first) >= k:
            known = np.sort(exact(i, first))[::-1]
            least = float(known[k - 1])
            for level in levels:
                upper = bound(i, rows, level)
                keep = upper + slack >= least
                rows, slack = rows[keep], slack[keep]
        score = exact(i, rows)
        best = np.lexsort((ids[rows], -score))[:k]
        out[0].append(np.full(len(best), query_id))
        out[1].append(ids[rows][best])
        out[2].append(np.array([int(s) for s in score[best]], np.int64))
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def search_integers(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = SHARD_ROWS,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k largest integer inner products for each row that ``queries`` selects.

    Components are floor(256 * x). Gives query_id, rank, vec_id and score; ties
    go to the smaller id. Rows with the query's id are no candidates. Rows
    without id and vectors that are NULL or hold NULL or non-finite components
    take no part; an empty vector is one of zeros. Products beyond a long are
    given as its limit.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))

    def compare(query_ids, q, ids, x, k):
        return top_integers(query_ids, np.floor(256 * q), ids, np.floor(256 * x), k)

    return search(rows.where(queries), rows, k, compare, "long", shard_rows, block_rows)
