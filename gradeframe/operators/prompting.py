"""Prompt tables, sampling parameters, sample fan-out and batch generation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gradeframe.operators.skew import join_same

# Sampling parameters per mode and token limits per benchmark.
SAMPLING = (
    # mode, temperature, top_p, top_k, presence_penalty
    ("think", 0.6, 0.95, 20, 0.0),
    ("nothink", 0.7, 0.8, 20, 1.5),
)
MAX_TOKENS = (
    ("aime24", 38912),
    ("aime25", 38912),
    ("math500", 32768),
    ("olympiadbench", 32768),
)
DEFAULT_MAX_TOKENS = 32768
CHOICE_MAX_TOKENS = 8192

Generator = Callable[[list[str]], list[list[str]]]


def _known_mode(mode: str) -> Column:
    message = F.concat(F.lit("unknown mode: "), F.coalesce(F.col(mode), F.lit("NULL")))
    return (F.when(F.col("temperature").isNull(), F.raise_error(message).cast("boolean"))
            .otherwise(F.lit(True)))


def with_sampling(df: DataFrame, k: int, mode: str = "mode") -> DataFrame:
    """Temperature and friends by mode; an unknown mode is an error."""
    table = df.sparkSession.createDataFrame(
        list(SAMPLING),
        f"{mode} string, temperature double, top_p double, top_k int, presence_penalty double")
    # Two fixed rows, so a broadcast is always right.
    return (df.join(F.broadcast(table), mode, "left").where(_known_mode(mode))
            .withColumn("n", F.lit(int(k))))


def with_math_sampling(df: DataFrame, k: int, mode: str = "mode",
                       benchmark: str = "benchmark") -> DataFrame:
    """Sampling parameters with the token limit of the benchmark."""
    limits = df.sparkSession.createDataFrame(
        list(MAX_TOKENS), f"{benchmark} string, max_tokens int")
    return (with_sampling(df, k, mode).join(F.broadcast(limits), benchmark, "left")
            .withColumn("max_tokens", F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS))))


def with_choice_sampling(df: DataFrame, k: int, mode: str = "mode") -> DataFrame:
    return with_sampling(df, k, mode).withColumn("max_tokens", F.lit(CHOICE_MAX_TOKENS))


def fan_out(df: DataFrame, k: int, index: str = "sample_idx") -> DataFrame:
    """k rows per prompt, numbered from 0."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(0), F.lit(int(k) - 1))))


def generate(prompts: DataFrame, make_generator: Callable[[], Generator], prompt: str = "prompt",
             batch_size: int | None = None) -> DataFrame:
    """Call a user's batch generator on every prompt; one row per sample.

    ``make_generator`` runs once per Python worker, which keeps what it returns, a
    function from a list of prompts to a list of k texts per prompt, for its later
    tasks. A worker keeps the generators of the last three calls. Output rows keep the
    other columns, so results are tied to their prompt by key. ``batch_size``
    bounds a call; by default a call takes one Arrow batch. A generator from a
    module of its own has to be shipped to the workers like any Python code.
    """
    kept = [f for f in prompts.schema.fields if f.name != prompt]
    schema = T.StructType(kept + [T.StructField("sample_idx", T.IntegerType()),
                                  T.StructField("output", T.StringType())])
    names = [f.name for f in kept]
    # Stands for this call; tasks that a worker runs later find the generator under it.
    key = uuid.uuid4()

    # Nested, so that it travels by value: workers need not have this package installed.
    def call(model: Generator, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = model(part.column(prompt).to_pylist())
        if len(texts) != part.num_rows:
            raise ValueError(f"generator returned {len(texts)} results for {part.num_rows} prompts")
        # The kept columns are picked by row and never become Python values.
        rows = pa.array([i for i, t in enumerate(texts) for _ in t], pa.int64())
        columns = [part.column(n).take(rows) for n in names]
        columns += [pa.array([i for t in texts for i in range(len(t))], pa.int32()),
                    pa.array([s for t in texts for s in t], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*names, "sample_idx", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ModelCache.get(key)
        if model is None:
            model = make_generator()
            ModelCache.add(key, model)
        for batch in batches:
            size = batch_size or max(batch.num_rows, 1)
            for start in range(0, batch.num_rows, size):
                yield call(model, batch.slice(start, size))

    return prompts.mapInArrow(run, schema)


def run_config(prompts: DataFrame, by: Sequence[str], k: int, prompt: str = "prompt",
               order_by: str = "example_id", messages: str | None = None) -> DataFrame:
    """Run log: prompt and generation counts and the first prompt of each run.

    The first id is found on numbers alone; only then one prompt per run is
    looked up, instead of sorting all prompt texts. ``order_by`` is unique in a run.
    ``messages`` names a column with chat messages to be logged as well.
    """
    by = list(by)
    runs = prompts.groupBy(*by).agg(F.min(order_by).alias(order_by),
                                    F.count(F.lit(1)).alias("examples"))
    said = [F.col(messages).alias("first_messages")] if messages else []
    first = prompts.select(*by, order_by, F.col(prompt).alias("first_prompt"), *said)
    return (join_same(first, runs, [*by, order_by], "inner")
            .withColumn("samples_per_example", F.lit(int(k)))
            .withColumn("generations", F.col("examples") * k)
            .drop(order_by))
