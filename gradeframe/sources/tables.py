"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ENOUGH_TASKS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan enough tasks for the costly text expressions above it.

    A file with a single row group is read by one task however many cores wait.
    Such inputs are small, so hashing them by their example key is cheap, and a
    later aggregation on the key needs no further exchange. A scan that already
    has enough tasks, hence every large table, is returned as it is.
    """
    width = min(df.sparkSession.sparkContext.defaultParallelism, _ENOUGH_TASKS)
    if df.rdd.getNumPartitions() >= width:
        return df
    return df.repartition(width, *keys)
