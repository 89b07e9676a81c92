"""Extraction over tables of samples: narrow projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions import choice, extract
from gradeframe.functions.text import blank_to_null


def extract_answers(df: DataFrame, text: str = "output", answer: str = "answer_text",
                    strategy: str | None = None, balanced: bool = False) -> DataFrame:
    """Add the extracted answer and, if named, the rule that produced it."""
    if strategy is None:
        return df.withColumn(answer, extract.extract_answer(text, balanced))
    # Each rule runs once, only where the earlier ones found nothing.
    rules = {
        "boxed": blank_to_null(extract.boxed_answer(text, balanced)),
        "fraction": extract.latex_fraction(text),
        "marker": extract.marked_answer(text),
        "number": extract.last_number(text),
        "last_line": extract.last_line(text),
    }
    staged, found = df, []
    for rule, expression in rules.items():
        if found:
            missing = F.coalesce(*found).isNull()
            expression = F.when(missing, expression)
        staged = staged.withColumn(f"__{rule}", expression)
        found.append(F.col(f"__{rule}"))
    fired: Column = F.lit(None).cast("string")
    for rule in reversed(rules):
        fired = F.when(F.col(f"__{rule}").isNotNull(), F.lit(rule)).otherwise(fired)
    return (staged.withColumn(answer, F.coalesce(*found)).withColumn(strategy, fired)
            .drop(*[f"__{rule}" for rule in rules]))


def extract_answer_arrays(df: DataFrame, outputs: str = "outputs",
                          answers: str = "predicted_answers", balanced: bool = False) -> DataFrame:
    """Extraction in array layout: rows stay whole, nothing is regrouped."""
    return df.withColumn(answers, F.transform(
        outputs, lambda text: extract.extract_answer(text, balanced)))


def extract_choice_arrays(df: DataFrame, outputs: str = "outputs", labels: str | None = None,
                          answers: str = "predicted_answers") -> DataFrame:
    """Choice letters in array layout."""
    valid = F.col(labels) if labels else choice.default_labels()
    return df.withColumn(answers, F.transform(
        outputs, lambda text: choice.choice_letter(text, valid)))


def extract_choices(df: DataFrame, text: str = "output", labels: str | None = None,
                    answer: str = "choice") -> DataFrame:
    """Add the choice letter, NULL where none is recognised.

    The upper-cased text and its reverse are only made for rows in which the
    phrase, line and word rules found nothing.
    """
    valid = F.col(labels) if labels else choice.default_labels()
    direct = F.coalesce(choice.phrase_choice(text, valid), choice.line_choice(text, valid),
                        choice.word_choice(text, valid))
    staged = (df.withColumn("__direct", direct)
              .withColumn("__upper", F.when(F.col("__direct").isNull(), F.upper(text)))
              .withColumn("__present", F.when(
                  F.col("__upper").isNotNull(), choice.labels_present("__upper", valid)))
              .withColumn("__reversed", F.when(F.size("__present") > 1, F.reverse("__upper"))))
    only = F.when(F.size("__present") == 1, F.get("__present", F.lit(0)))
    last = F.when(F.size("__present") > 1,
                  choice.last_bounded("__upper", "__reversed", "__present"))
    return (staged.withColumn(answer, F.coalesce("__direct", only, last))
            .drop("__direct", "__upper", "__present", "__reversed"))


def strategy_histogram(df: DataFrame, *by: str, strategy: str = "strategy") -> DataFrame:
    return df.groupBy(*by, strategy).agg(F.count(F.lit(1)).alias("samples"))
