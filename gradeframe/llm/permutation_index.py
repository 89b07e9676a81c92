"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. So that near means a
large inner product, vectors get a component more before: it fills a row up to
the length of the longest and is 0 for a query. Each shard posts its vectors, with the pivot's position, in one inverted file per pivot. A query
reads the files of its own nearest pivots only, ranks what it meets by the
footrule distance of the two orders and reranks the first by inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.vectors import BLOCK_ROWS, SHARD_ROWS, finite, matrix, search

PIVOTS = 512
DEPTH = 64
CANDIDATES = 0.16  # share of a shard's distinct vectors that is reranked,
LEAST = 400  # and how many at least


def usable(embedding: Column) -> Column:
    """Finite vectors with a component other than zero."""
    return finite(embedding) & F.exists(embedding, lambda x: x != 0)


def longest(vectors: DataFrame) -> float:
    """Largest length of a vector, 1 without vectors."""
    def lengths(batches):
        for batch in batches:
            sizes = np.diff(batch["embedding"].offsets.to_numpy())
            x = matrix(batch["embedding"], max(sizes, default=0))
            if x.size:
                most = np.abs(x).max()
                yield pa.RecordBatch.from_pydict({"length": [most * np.sqrt(((x / most) ** 2).sum(1).max())]})

    found = vectors.select("embedding").mapInArrow(lengths, "length double").agg(F.max("length")).first()[0]
    return min(found or 1.0, np.finfo(float).max)


def filled(x: np.ndarray, most: float) -> np.ndarray:
    """Rows in units of ``most``, after a component that fills each up to length 1."""
    x = x / most
    return np.column_stack([np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1))), x])


def asking(q: np.ndarray) -> np.ndarray:
    """Queries beside filled rows: their angles order rows by inner product."""
    return np.column_stack([np.zeros(len(q)), q])


def sample_pivots(vectors: DataFrame, most: float, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` distinct filled vectors from those with the smallest hashes.

    At most four times as many rows come to the driver, to make up for copies.
    """
    rows = (vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding")
            .limit(4 * pivots).toArrow())
    width = max((len(v) for v in rows["embedding"].to_pylist()), default=1)
    x = filled(matrix(rows["embedding"], width), most)
    _, at = np.unique(x, axis=0, return_index=True)
    return x[np.sort(at)[:pivots]]


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """Indices of the nearest pivots of each row, nearest first."""
    width = max(x.shape[1], pivots.shape[1])
    near = np.pad(x, ((0, 0), (0, width - x.shape[1]))) @ np.pad(
        pivots, ((0, 0), (0, width - pivots.shape[1]))).T
    top = np.argpartition(-near, depth - 1, axis=1)[:, :depth]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, pivots: int = PIVOTS, depth: int = DEPTH,
            candidates: float = CANDIDATES, least: int = LEAST, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows with the largest inner product found for each row that ``queries`` selects.

    Gives query_id, rank, vec_id and score, the inner product in double
    precision, summed component by component; ties go to the smaller id. Rows
    with the query's id are no candidates. Rows without id and vectors that are
    NULL, zero or hold NULL or non-finite components take no part. The index is
    fitted on a sample of ``pivots`` rows; all rows are in it. Of a shard's
    distinct vectors the share ``candidates``, and ``least`` at least, is
    reranked, more at ties of the footrule distance; shards of any size go
    through the inverted files. Equal vectors stand in the index once, so that
    copies do not crowd out others.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    most = longest(rows)
    chosen = sample_pivots(rows, most, pivots)
    deep = min(depth, max(1, len(chosen)))

    def compare(query_ids, q, ids, x, k):
        _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
        distinct = x[first]
        columns = np.ascontiguousarray(distinct.T)
        members = np.lexsort((ids, group))  # of each distinct vector, ids ascending
        begin = np.searchsorted(group[members], np.arange(len(first) + 1))
        reranked = min(len(first), max(least, math.ceil(candidates * len(first))))
        near = orders(filled(distinct, most), chosen, deep)
        pivot, place = near.ravel(), np.tile(np.arange(deep), len(near))
        order = np.argsort(pivot, kind="stable")
        posts, places = np.repeat(np.arange(len(near)), deep)[order], place[order]
        files = np.searchsorted(pivot[order], np.arange(len(chosen) + 1))
        asked = orders(asking(q), chosen, deep)
        out = [], [], []
        for i, query_id in enumerate(query_ids):
            spans = [slice(files[p], files[p + 1]) for p in asked[i]]
            met = np.concatenate([posts[s] for s in spans])
            # Footrule distance is a constant less twice these shares of common pivots.
            share = deep - np.maximum(np.concatenate([places[s] for s in spans]), np.repeat(
                np.arange(deep), [s.stop - s.start for s in spans]))
            shared = np.bincount(met, share, len(first))
            cut = np.argpartition(-shared, reranked - 1)[:reranked]
            # At the cut all with the same distance stay.
            pool = np.flatnonzero(shared >= shared[cut].min()) if shared[cut].min() > 0 else cut
            score = np.zeros(len(pool))
            for j in range(len(columns)):
                score += q[i, j] * columns[j, pool]
            keep = k + 1
            if len(pool) > keep:
                edge = -np.partition(-score, keep - 1)[keep - 1]
                pool, score = pool[score >= edge], score[score >= edge]
            rows_ = [members[begin[v]:min(begin[v + 1], begin[v] + keep)] for v in pool]
            score = np.repeat(score, [len(r) for r in rows_])
            found = ids[np.concatenate(rows_)]
            score, found = score[found != query_id], found[found != query_id]
            best = np.lexsort((found, -score))[:k]
            out[0].append(np.full(len(best), query_id))
            out[1].append(found[best])
            out[2].append(score[best])
        return [np.concatenate(o) for o in out]

    return search(rows.where(queries), rows, k, compare, "double", shard_rows, block_rows)
