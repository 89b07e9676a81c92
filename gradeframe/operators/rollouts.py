"""Mixing rollouts of two sources and group-relative advantages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeframe.functions.passk import annealing_weight
from gradeframe.operators.skew import hot_keys, join_same, key_hash

EXPLORER, LEARNER = "explorer", "learner"


def explorer_quota(step: str, mix_steps: int, group_size: int) -> Column:
    """Samples taken from the explorer; the rest of the group is the learner's."""
    share = annealing_weight(step, mix_steps) * group_size
    # 0.30000000000000004 * 10 must not become 4.
    return F.ceil(F.round(share, 9)).cast("int")


def with_quotas(df: DataFrame, mix_steps: int, group_size: int, step: str = "step") -> DataFrame:
    explorer = explorer_quota(step, mix_steps, group_size)
    return df.withColumns({
        "alpha": annealing_weight(step, mix_steps),
        "explorer_quota": explorer,
        "learner_quota": F.lit(group_size) - explorer,
    })


def mixture_schedule(spark: SparkSession, total_steps: int, mix_steps: int,
                     group_size: int) -> DataFrame:
    steps = spark.range(1, total_steps + 1).select(F.col("id").alias("step"))
    return with_quotas(steps, mix_steps, group_size)


def mixed_group(rollouts: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                mix_steps: int, group_size: int, step: str = "step", source: str = "source",
                seed: int | None = None) -> DataFrame:
    """Keep each source's quota of rollouts per group.

    The first rollouts in ``order_by`` order are kept, or a seeded draw. Quotas
    follow from the step, so no join is needed, and the constant bound lets
    Spark drop surplus rows before the shuffle: no task sees more than
    ``group_size`` rows per group from any input partition.
    """
    order = [F.col(c) for c in order_by]
    if seed is not None:
        order = [F.xxhash64(F.lit(seed), *[F.col(c) for c in [*keys, *order_by]]), *order]
    rank = F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order))
    quota = F.when(F.col(source) == EXPLORER, explorer_quota(step, mix_steps, group_size)).otherwise(
        F.lit(group_size) - explorer_quota(step, mix_steps, group_size))
    # Sources without a quota at a step are dropped before anything is sorted or moved.
    return (rollouts.where(F.col(source).isin(EXPLORER, LEARNER)).where(quota > 0)
            .withColumn("__rank", rank)
            .where(F.col("__rank") <= group_size).where(F.col("__rank") <= quota)
            .drop("__rank"))


def group_advantage(rollouts: DataFrame, keys: Sequence[str], reward: str = "reward",
                    std: str = "pop", name: str = "advantage", bounded: bool = False,
                    min_rows: int | None = None) -> DataFrame:
    """(reward - mean) / standard deviation within the group, 0 where it is 0.

    Groups of ordinary size take one window. The rows of hot groups, if there
    are any, are aggregated with map-side combine instead, and the few moments
    are broadcast back to them. ``bounded`` skips the search for hot groups,
    for groups built by ``mixed_group``.
    """
    if std not in ("pop", "samp"):
        raise ValueError(f"std must be pop or samp, not {std!r}")
    deviation = F.stddev_pop(reward) if std == "pop" else F.stddev_samp(reward)
    moments = {"__mean": F.avg(reward), "__std": deviation}
    hot = [] if bounded else hot_keys(rollouts, keys, min_rows)
    is_hot = key_hash(keys).isin([h.key_hash for h in hot])

    window = Window.partitionBy(*keys)
    cold = rollouts.where(~is_hot) if hot else rollouts
    scored = cold.withColumns({n: m.over(window) for n, m in moments.items()})
    if hot:
        rows = rollouts.where(is_hot)
        # One row per hot group; Spark broadcasts them if they are small.
        few = rows.groupBy(*keys).agg(*[m.alias(n) for n, m in moments.items()])
        scored = scored.unionByName(join_same(rows, few, keys, "inner"))
    scaled = F.try_divide(F.col(reward) - F.col("__mean"), F.col("__std"))
    # A group of equal rewards can carry a rounding residue instead of a clean 0.
    flat = F.coalesce(F.abs("__std") < 1e-12, F.lit(True))
    return (scored.withColumn(name, F.when(flat, F.lit(0.0)).otherwise(scaled))
            .drop("__mean", "__std"))
