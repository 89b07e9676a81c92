"""Searches of a set of query rows against all rows, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16384
BLOCK_ROWS = 4096


def finite(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(embedding, lambda x: F.coalesce(
        (x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def search(queries: DataFrame, rows: DataFrame, k: int, compare: Callable, score_type: str,
           shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) per query, ties to smaller ids.

    ``queries`` and ``rows`` have vec_id and embedding. Rows are dealt into
    shards and queries into blocks by hash; ``compare(query_ids, q, ids, x, k)``
    sees one block and one shard and gives arrays (query_id, vec_id, score) with
    the best k of that shard per query. Both sides of a meeting are bounded,
    whatever the number of rows, and only k rows per query and shard leave it.
    Of rows that agree in id and vector one counts. Vectors of different
    lengths meet as if the shorter ones ended in zeros.
    """
    width = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    asked = queries.count()
    shards, blocks = max(1, -(-width[1] // shard_rows)), max(1, -(-asked // block_rows))
    width = max(1, width[0] or 1)

    def number(count):
        return F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.select(number(blocks).alias("block"), every(shards).alias("shard"), "vec_id", "embedding")
    right = rows.select(every(blocks).alias("block"), number(shards).alias("shard"), "vec_id", "embedding")
    kind = pa.int64() if score_type == "long" else pa.float64()

    def own(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, x = table["vec_id"].to_numpy(), matrix(table["embedding"], width)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)
        return ids[new], x[new]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]
        if a.num_rows and b.num_rows:
            found = compare(*own(a), *own(b), k)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()),
                         pa.array(found[2]).cast(kind)], ["query_id", "vec_id", "score"])

    met = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(
        meet, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
