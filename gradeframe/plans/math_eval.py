"""Math evaluation end to end: generations in, benchmark results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeframe.functions import prompts
from gradeframe.operators import extraction, layout, prompting, scoring


def math_prompts(items: DataFrame, mode: str, k: int) -> DataFrame:
    """Prompt table: messages and sampling parameters per question."""
    moded = items.withColumn("mode", F.lit(mode))
    return prompting.with_math_sampling(
        moded.withColumn("messages", prompts.chat_messages("question", "mode")), k)


def run_log(prompt_table: DataFrame, model_path: str, run_ts: str, k: int,
            prompt: str = "prompt", order_by: str = "example_id") -> DataFrame:
    """One row per benchmark of a run: parameters, counts, and the first prompt and messages.

    ``run_ts`` is the time of the run.
    """
    named = prompt_table.withColumns({
        "model": prompts.model_name(F.lit(model_path)), "run_ts": F.lit(run_ts)})
    by = ["model", "run_ts", "benchmark", "mode", "temperature", "top_p", "top_k",
          "presence_penalty", "max_tokens"]
    messages = "messages" if "messages" in prompt_table.columns else None
    return prompting.run_config(named, by, k, prompt, order_by, messages)


def judged_samples(samples: DataFrame, balanced: bool = False, strict: bool = False) -> DataFrame:
    """Long samples with ``output`` and ``gold`` to verdicts."""
    extracted = extraction.extract_answers(samples, balanced=balanced)
    return scoring.judge(extracted, strict=strict)


def score_samples(samples: DataFrame, keys: Sequence[str] = ("benchmark", "example_id"),
                  **options: bool) -> DataFrame:
    """Per-example counts; the only large shuffle, after a partial aggregate."""
    return scoring.example_scores(judged_samples(samples, **options), keys)


def example_curves(samples: DataFrame, keys: Sequence[str] = ("benchmark", "example_id")) -> DataFrame:
    """Pass@1..n of each example."""
    return scoring.example_pass_at_k(score_samples(samples, keys))


def score_raw(raw: DataFrame, by: Sequence[str] = ("benchmark",),
              ks: Sequence[int] | None = None, on_short: str = "error") -> DataFrame:
    """Array-layout generations to one summary row per benchmark."""
    samples = layout.explode_samples(raw.withColumnRenamed("answer", "gold"), keep_empty=True)
    scores = scoring.example_scores(judged_samples(samples), [*by, "example_id"],
                                    position="sample_idx")
    return scoring.benchmark_summary(scores, by, ks, on_short)


def score_answers(answers: DataFrame, by: Sequence[str] = ("benchmark",),
                  ks: Sequence[int] | None = None, on_short: str = "error") -> DataFrame:
    """Already extracted answers to one summary row per benchmark."""
    samples = layout.explode_samples(answers.withColumnRenamed("answer", "gold"),
                                     "predicted_answers", "answer_text", keep_empty=True)
    scores = scoring.example_scores(scoring.judge(samples), [*by, "example_id"],
                                    position="sample_idx")
    return scoring.benchmark_summary(scores, by, ks, on_short)
