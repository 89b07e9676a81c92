"""Writers. Runs are partitions, so a rerun replaces only its own data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.operators.layout import collect_samples
from gradeframe.sources import jsonl

RUN_KEYS = ("model", "run_ts")


def run_timestamp(moment: datetime) -> str:
    """Twelve-digit run id; taken once on the driver and passed in as a literal."""
    return moment.strftime("%y%m%d%H%M%S")


def append_generations(samples: DataFrame, path: str, by: Sequence[str] = RUN_KEYS,
                       batch: str | None = None, format: str = "parquet") -> None:
    """Append a batch of generations; earlier batches are never rewritten.

    With ``batch``, a name for the batch, its rows go to a partition of their
    own, and writing the batch again replaces them instead of doubling them.
    Rows are dealt by run before they are written, so a run gets few files.
    """
    dealt = _dealt(samples, by)
    if batch is None:
        dealt.write.mode("append").partitionBy(*by).format(format).save(path)
    else:
        write_run(samples.withColumn("batch", F.lit(batch)), path, [*by, "batch"], format)


def _dealt(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a run close together; Spark splits a run that is large and merges small ones."""
    return df.hint("rebalance", *[F.col(c) for c in by])


def write_run(df: DataFrame, path: str, by: Sequence[str] = RUN_KEYS,
              format: str = "parquet") -> None:
    """Write one or more runs, replacing just the partitions that occur in ``df``."""
    (_dealt(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).format(format).save(path))


def write_answers(samples: DataFrame, path: str, keys: Sequence[str] = ("question", "answer"),
                  answer: str = "answer_text", by: Sequence[str] = ("benchmark",)) -> None:
    """Extracted answers of long samples as JSON lines, one example per line."""
    grouped = collect_samples(samples, [*by, "example_id", *keys], answer, "predicted_answers")
    _json(grouped.drop("example_id"), path, by)


def write_answer_arrays(answers: DataFrame, path: str, by: Sequence[str] = ("benchmark",)) -> None:
    """Extracted answers already in array layout as JSON lines."""
    _json(answers.select(*by, "question", "answer", "predicted_answers"), path, by)


def write_choice_results(results: DataFrame, path: str, by: Sequence[str] = ("benchmark",)) -> None:
    """Choice results as JSON lines; NULL answers stay in their place."""
    _json(results, path, by)


def write_results(summary: DataFrame, path: str, by: Sequence[str] = ("benchmark",)) -> None:
    """Result rows, one folder per benchmark."""
    _json(summary, path, by)


def write_summary(summary: DataFrame, path: str) -> None:
    """All result rows in one place; no result gives an empty dataset."""
    summary.write.mode("overwrite").json(path)


def append_run_config(configs: DataFrame, path: str) -> None:
    configs.write.mode("append").json(path)


def _json(df: DataFrame, path: str, by: Sequence[str]) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).json(path))


def write_checked(records: DataFrame, path: str) -> None:
    """Records of ``jsonl.checked``, good ones and rejects apart, from one pass over the input."""
    status = F.when(F.col("rejected").isNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    records.withColumn("status", status).write.mode("overwrite").partitionBy("status").parquet(path)


def read_written(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_checked`` wrote: good records and the reject table, each read from its own folder only."""
    records = spark.read.parquet(path)
    return (jsonl.accepted(records.where("status = 'accepted'").drop("status")),
            jsonl.rejected(records.where("status = 'rejected'")))
