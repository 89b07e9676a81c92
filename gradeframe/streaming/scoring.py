"""Extraction and judging of generations while they arrive.

All expressions are stateless, so the batch operators run on a stream as they
are. New files are picked up once and results are appended, instead of
rewriting a growing snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gradeframe.operators import extraction, scoring
from gradeframe.sources import sinks


def read_generation_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def judged_stream(samples: DataFrame) -> DataFrame:
    return scoring.judge(extraction.extract_answers(samples))


def choice_stream(samples: DataFrame, labels: Column | str | None = None) -> DataFrame:
    """Choice letters of a stream of samples, by the rules of the batch."""
    return extraction.extract_choices(samples, labels=labels) if labels is not None else extraction.extract_choices(samples)


def append_batches(stream: DataFrame, path: str, checkpoint: str,
                   transform: Callable[[DataFrame], DataFrame] = judged_stream,
                   by: Sequence[str] = sinks.RUN_KEYS, name: str = "stream",
                   format: str = "parquet") -> StreamingQuery:
    """Process everything that is there in batches, each a named batch of the sink, and stop.

    A batch that is run again after a failure, because it was written but not
    committed, replaces itself instead of doubling its rows. ``name`` keeps the
    batches of several streams into one place apart. ``checkpoint`` must be in
    storage that all executors share.
    """
    def write(batch: DataFrame, number: int) -> None:
        sinks.append_generations(transform(batch), path, by, f"{name}-{number:09d}", format)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def append_available(stream: DataFrame, path: str, checkpoint: str,
                     transform: Callable[[DataFrame], DataFrame] = judged_stream) -> StreamingQuery:
    """Process everything that is there, append it and stop.

    ``checkpoint`` must be in storage that all executors share.
    """
    return (transform(stream).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
