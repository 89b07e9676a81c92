"""Ways to keep one hot key from landing in one task.

A key is hot when it has more rows than one task should hold, a fixed number
whatever the size of the data. Inputs with fewer rows than that have no hot key
and are only counted. For others detection is one pass over the key columns with
a frequent-items sketch sized for the number of keys that can be hot: keys are
not shuffled, and sketches are merged in two levels, so that no task has to take
the sketches of all input tasks. The sketch only decides how rows are spread;
results are exact with any list of hot keys.

Detection runs a job while a query is built. Only ``with_position`` and the
callers of ``hot_keys`` need it; joins are left to Spark's own skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

HOT_ROWS = 2_000_000  # rows of one key that a single task may hold
# Sketches hold at least this many items, and at most what Spark's sketch allows.
# With the largest, keys above HOT_ROWS are found in up to 5e11 rows.
_LEAST_ITEMS, _MOST_ITEMS = 8192, 1_000_000
_MERGE_GROUPS = 512

_HASH, _SLICE = "__key_hash", "__slice"


@dataclass(frozen=True)
class HotKey:
    key_hash: int
    rows: int
    splits: int


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> list[HotKey]:
    """Keys with more rows than ``min_rows``, by default what a task may hold.

    The list has at most one item per ``min_rows`` rows of the data.
    """
    limit = HOT_ROWS if min_rows is None else min_rows
    total = df.count()
    if total <= limit:
        return []
    possible = total // limit + 1
    items = min(_MOST_ITEMS, max(_LEAST_ITEMS, 4 * possible))
    merger = F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS))
    sketch = (df.select(key_hash(keys).alias("h"), merger.alias("merger"))
              .groupBy("merger")
              .agg(F.expr(f"approx_top_k_accumulate(h, {items})").alias("part"))
              .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(part), {min(possible, items)})").alias("top"))
              .first())
    return [HotKey(r["item"], r["count"], ceil(r["count"] / limit))
            for r in (sketch["top"] or []) if r["count"] > limit]


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL, as in a grouping; left's columns come first."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__right_{k}"])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def with_position(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str,
                  min_rows: int | None = None) -> DataFrame:
    """Zero-based position of a row in its group, in ``order_by`` order.

    ``order_by`` must be unique within a group. Groups of ordinary size take one
    window. A hot group is cut into ranges of the order columns, so that no task
    sorts more than a share of it; positions are the local ones plus the number
    of rows in earlier ranges.
    """
    keys, order_by = list(keys), list(order_by)
    hot = hot_keys(df, keys, min_rows)
    if not hot:
        window = Window.partitionBy(*keys).orderBy(*order_by)
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))

    sliced = _with_slice(df, keys, order_by, hot)
    local = F.row_number().over(Window.partitionBy(*keys, _SLICE).orderBy(*order_by))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, -1)
    # One row per range, each of about HOT_ROWS rows; Spark broadcasts it if it is small.
    offsets = (sliced.where(F.col(_HASH).isin([h.key_hash for h in hot]))
               .groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("__rows"))
               .withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
               .drop("__rows"))
    return (join_same(sliced.withColumn("__local", local), offsets,
                      [*keys, _SLICE], "left")
            .withColumn(name, (F.col("__local") - 1 + F.coalesce("__before", F.lit(0)))
                        .cast("long"))
            .select(*df.columns, name))


def _with_slice(df: DataFrame, keys: list[str], order_by: list[str],
                hot: list[HotKey]) -> DataFrame:
    """Tag rows of hot groups with the range of the order columns they fall in."""
    bounds = _range_bounds(df, keys, order_by, hot)
    point = F.struct(*[F.col(c) for c in order_by])
    steps = max((len(b["bounds"]) for b in bounds), default=0).bit_length() + 1

    def halve(state: Column, _: Column) -> Column:
        low, high = state["low"], state["high"]
        middle = F.floor((low + high) / 2).cast("int")
        above = F.get("__bounds", middle) <= point
        return F.when(low >= high, state).otherwise(F.struct(
            F.when(above, middle + 1).otherwise(low).alias("low"),
            F.when(above, high).otherwise(middle).alias("high")))

    # Binary search: the number of bounds at or below the row.
    start = F.struct(F.lit(0).alias("low"), F.size("__bounds").alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["low"])
    schema = T.StructType([
        T.StructField(_HASH, T.LongType()),
        T.StructField("__bounds", T.ArrayType(T.StructType(
            [T.StructField(c, df.schema[c].dataType) for c in order_by]))),
    ])
    table = df.sparkSession.createDataFrame(bounds, schema)
    return (df.withColumn(_HASH, key_hash(keys)).join(F.broadcast(table), _HASH, "left")
            .withColumn(_SLICE, F.when(F.col("__bounds").isNull(), F.lit(0)).otherwise(found))
            .drop("__bounds"))


def _range_bounds(df: DataFrame, keys: list[str], order_by: list[str],
                  hot: list[HotKey], per_split: int = 50) -> list[Row]:
    """Sampled range bounds per hot key.

    The sample holds about ``per_split`` rows per range and the ranges number at
    most two per ``HOT_ROWS`` rows. Bounds only steer balance; any bounds give the same
    positions, and as literals they are the same in every re-run of a task.
    """
    fraction = min(1.0, per_split * sum(h.splits for h in hot) / sum(h.rows for h in hot))
    splits = F.create_map(*[F.lit(v) for h in hot for v in (h.key_hash, h.splits)])
    sampled = (df.select(key_hash(keys).alias(_HASH), F.struct(*order_by).alias("point"))
               .where(F.col(_HASH).isin([h.key_hash for h in hot]))
               .sample(fraction, seed=1)
               .groupBy(_HASH).agg(F.array_sort(F.collect_list("point")).alias("points")))
    width = F.greatest(F.floor(F.size("points") / splits[F.col(_HASH)]), F.lit(1)).cast("int")
    bounds = F.filter("points", lambda _, i: (i > 0) & (i % width == 0))
    return sampled.select(_HASH, bounds.alias("bounds")).collect()
