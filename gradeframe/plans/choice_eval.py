"""Multiple-choice evaluation end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions import prompts
from gradeframe.operators import extraction, prompting, voting


def choice_prompts(items: DataFrame, mode: str, k: int) -> DataFrame:
    moded = items.withColumn("mode", F.lit(mode))
    messages = prompts.choice_messages("question", "choices.label", "choices.text", "mode")
    return prompting.with_choice_sampling(moded.withColumn("messages", messages), k)


def choice_results(raw: DataFrame) -> DataFrame:
    """Array-layout generations with the letter of each sample."""
    return extraction.extract_choice_arrays(raw, labels="choices.label")


def score_choice_raw(raw: DataFrame, by: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Array-layout choice generations to the statistics per benchmark."""
    return voting.array_accuracy(choice_results(raw), by, key="answerKey")


def checkpoint_curve(samples: DataFrame, keys: Sequence[str],
                     by: Sequence[str] = ("strategy", "step"), labels: Sequence[str] | None = None,
                     **columns: str) -> DataFrame:
    """Statistics per checkpoint in one grouped job instead of a run per step."""
    return voting.choice_accuracy(samples, by, keys, labels=labels, **columns)
