"""Run logs: the last metric lines of each log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed value: what a metric line looks like.
METRIC_LINE = "pass@1|accuracy_any|Pass@1"


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Log lines with their file, by path, its name, and a number that grows down the file."""
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("log"),
                    F.col("_metadata.file_name").alias("log_name"),
                    F.monotonically_increasing_id().alias("line_no"),
                    F.col("value").alias("line")))


def log_tail(lines: DataFrame, pattern: str = METRIC_LINE, last: int = 10,
             by: Sequence[str] = ("log",), order_by: Sequence[str] = ("line_no",),
             line: str = "line") -> DataFrame:
    """The last matching lines of each log.

    The constant limit is applied in every input partition before the shuffle.
    """
    window = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order_by])
    return (lines.where(F.rlike(F.col(line), F.lit(pattern)))
            .withColumn("__rank", F.row_number().over(window))
            .where(F.col("__rank") <= last).drop("__rank"))
