"""Array layout (one row per example) and long layout (one row per sample)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

RANGE_BLOCK = 4096  # rows of a range per block; only the plan depends on it


def explode_samples(df: DataFrame, array: str = "outputs", value: str = "output",
                    index: str = "sample_idx", keep_empty: bool = False) -> DataFrame:
    """One row per array element.

    Examples with an empty array vanish, or stay as one row without a position.
    The outer form also keeps Spark from testing the array size in a filter of
    its own, which would compute a derived array twice.
    """
    others = [c for c in df.columns if c != array]
    rows = df.select(*others, F.posexplode_outer(array).alias(index, value))
    return rows if keep_empty else rows.where(F.col(index).isNotNull())


def collect_samples(df: DataFrame, keys: Sequence[str], value: str, array: str,
                    index: str = "sample_idx") -> DataFrame:
    """One row per example, elements in order, whatever their number.

    The array layout holds an example in one row. Examples too large for a row
    belong in the long layout, which every operator takes as well.
    """
    # Pairs keep NULL elements, which a bare collect_list would drop.
    pairs = F.array_sort(F.collect_list(F.struct(F.col(index), F.col(value))))
    return (df.groupBy(*keys).agg(pairs.alias("__pairs"))
            .select(*keys, F.transform("__pairs", lambda p: p[value]).alias(array)))


def explode_range(df: DataFrame, last: str, name: str, first: int = 1, block: int = RANGE_BLOCK,
                  spread: bool = False) -> DataFrame:
    """Rows first..last for each input row, via blocks, so no long array is built.

    ``spread`` shuffles the blocks, so that a range of billions is produced by
    many tasks; without it the task of the input row produces all of them.
    """
    end = F.col(last).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((end - first) / block))
    lower = F.col("__block") * block + first
    blocked = df.where(F.col(last) >= first).withColumn("__block", F.explode(blocks))
    if spread:
        # A fixed number: AQE would merge the blocks, which are small until expanded.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocked = blocked.repartition(tasks, *df.columns, "__block")
    return (blocked
            .withColumn(name, F.explode(F.sequence(lower, F.least(lower + (block - 1), end))))
            .drop("__block"))
