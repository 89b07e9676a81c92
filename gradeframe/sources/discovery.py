"""Finding benchmarks and checkpoints in partitioned data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.text import ColumnLike, as_column
from gradeframe.sources.jsonl import MATH_BENCHMARKS


def only_benchmarks(df: DataFrame, names: Sequence[str] = tuple(MATH_BENCHMARKS),
                    benchmark: str = "benchmark") -> DataFrame:
    """Known benchmarks of a dataset; prunes partitions when partitioned by it."""
    return df.where(F.col(benchmark).isin(list(names)))


def absent(df: DataFrame, expected: Sequence[str], column: str = "benchmark") -> DataFrame:
    """Expected names that the data lacks."""
    wanted = df.sparkSession.createDataFrame([(n,) for n in expected], f"{column} string")
    return wanted.join(df.select(column).distinct(), column, "left_anti")


def read_partitions(spark: SparkSession, path: str, benchmarks: Sequence[str] | None = None,
                    checkpoints: Sequence[str] | None = None, schema: str | None = None,
                    format: str = "parquet") -> DataFrame:
    """A dataset in folders ``benchmark=…/`` and, if asked for, ``checkpoint=…/``.

    Names become partition filters, so folders of other names are not opened.
    ``schema`` has the data's columns; without it Spark looks at the files.
    """
    # Names are texts even where all of them look like numbers.
    reader = spark.read.format(format)
    names = ["benchmark"] + ([] if checkpoints is None else ["checkpoint"])
    if schema is not None:
        reader = reader.schema(", ".join([schema, *[f"{n} string" for n in names]]))
    df = reader.load(path)
    if benchmarks is not None:
        df = only_benchmarks(df, benchmarks)
    return df if checkpoints is None else df.where(F.col("checkpoint").isin(list(checkpoints)))


def partition_report(df: DataFrame, expected: Sequence[str], column: str = "benchmark") -> DataFrame:
    """Which of the expected names the dataset has: name, found.

    Reads partition values alone. The expected names are a list of the caller's, so they are broadcast.
    """
    there = df.where(F.col(column).isin(list(expected))).select(F.col(column).cast("string").alias(column)).distinct()
    wanted = df.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(expected)], f"{column} string")
    return F.broadcast(wanted).join(there.withColumn("__there", F.lit(True)), column, "left").select(
        column, F.coalesce("__there", F.lit(False)).alias("found"))


def checkpoint_step(name: ColumnLike) -> Column:
    """The last number in a checkpoint name, its step."""
    digits = F.regexp_extract(as_column(name), r"(\d+)(?!.*\d)", 1)
    return digits.try_cast("bigint")


def natural_order(name: ColumnLike) -> Column:
    """A sort key for names with numbers: texts compare as texts and numbers by value.

    The name's pieces with the digits of each number behind their count, so that
    9 comes before 10. Leading zeros only decide between equal numbers.
    """
    text = as_column(name)
    pieces = F.regexp_extract_all(text, F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=\\d)", "")
    keyed = F.transform(pieces, lambda p: F.when(
        F.rlike(p, F.lit("^\\d")), F.concat(F.lpad(F.length(bare(p)).cast("string"), 6, "0"), bare(p)))
        .otherwise(p))
    return F.struct(keyed.alias("pieces"), text.alias("name"))


def expected_checkpoint(strategy: ColumnLike, step_name: ColumnLike) -> Column:
    return F.concat_ws("_", as_column(strategy), as_column(step_name))


def skipped_checkpoints(steps: DataFrame, found: DataFrame, strategy: str = "strategy",
                        step_name: str = "step_name",
                        checkpoint: str = "checkpoint") -> DataFrame:
    """Steps whose expected checkpoint folder does not exist."""
    named = steps.withColumn(checkpoint, expected_checkpoint(strategy, step_name))
    return named.join(found.select(checkpoint).distinct(), checkpoint, "left_anti")
