"""Comparing metric tables: curves, crossovers, deltas.

Inputs are aggregated metrics, one row per model, benchmark and k or step, so
these joins and windows are small whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def crossover(curve: DataFrame, small: str, large: str, by: Sequence[str] = ("benchmark",),
              model: str = "model", k: str = "k", value: str = "pass_at_k") -> DataFrame:
    """Smallest k at which the small model beats the large one, NULL if never.

    Both curves are laid side by side in one aggregation, so the metric is
    computed once. Only ks that both models have are compared.
    """
    def of(name: str) -> Column:
        return F.max(F.when(F.col(model) == name, F.col(value)))

    pairs = (curve.where(F.col(model).isin(small, large)).groupBy(*by, k)
             .agg(of(small).alias("__small"), of(large).alias("__large"))
             .where(F.col("__small").isNotNull() & F.col("__large").isNotNull()))
    ahead = F.col("__small") > F.col("__large")
    return (pairs.groupBy(*by)
            .agg(F.min(F.when(ahead, F.col(k))).alias("crossover_k"),
                 F.count_if(ahead).alias("ks_ahead"), F.count(F.lit(1)).alias("ks_compared"))
            .withColumns({"small_model": F.lit(small), "large_model": F.lit(large)}))


def delta_to_baseline(metrics: DataFrame, baseline: str, on: Sequence[str],
                      method: str = "method", value: str = "value",
                      scale: float = 1.0) -> DataFrame:
    """Difference of every other method to the baseline, ``scale`` 100 for points.

    A window over one metric cell, whose rows are the methods compared.
    """
    base = F.max(F.when(F.col(method) == baseline, F.col(value))).over(Window.partitionBy(*on))
    return (metrics.withColumn("baseline_value", base)
            .where((F.col(method) != baseline) & F.col("baseline_value").isNotNull())
            .withColumn("delta", (F.col(value) - F.col("baseline_value")) * scale))


def mean_delta(deltas: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    return deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta"),
                                   F.count(F.lit(1)).alias("compared"))


def step_delta(curve: DataFrame, value: str, by: Sequence[str] = (), step: str = "step",
               name: str = "change") -> DataFrame:
    """Change of a metric against the previous checkpoint of the same series."""
    window = Window.partitionBy(*by).orderBy(step)
    return curve.withColumn(name, F.col(value) - F.lag(value).over(window))
