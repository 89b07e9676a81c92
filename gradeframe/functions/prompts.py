"""Prompt and model-name expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import ColumnLike, as_column

# Mode switches and the instruction of a choice prompt.
THINK_SUFFIX = "/think"
NO_THINK_SUFFIX = "/no_think"
CHOICE_INSTRUCTION = "Answer with only the letter (A, B, C, D, or E)."


def model_name(path: ColumnLike) -> Column:
    """Last segment of a model path."""
    return F.substring_index(F.rtrim(as_column(path), F.lit("/")), "/", -1)


def user_content(question: ColumnLike, mode: ColumnLike) -> Column:
    """Question with its mode switch; every mode but 'think' is non-thinking."""
    suffix = F.when(as_column(mode) == "think", F.lit(THINK_SUFFIX)).otherwise(
        F.lit(NO_THINK_SUFFIX))
    return F.concat(as_column(question), F.lit(" "), suffix)


def chat_messages(question: ColumnLike, mode: ColumnLike) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"),
                            user_content(question, mode).alias("content")))


def format_choices(labels: ColumnLike, texts: ColumnLike) -> Column:
    """``A. text`` lines, as many as both lists have."""
    labels, texts = as_column(labels), as_column(texts)
    shared = F.slice(F.arrays_zip(labels.alias("label"), texts.alias("text")), F.lit(1),
                     F.least(F.size(labels), F.size(texts)))
    return F.array_join(
        F.transform(shared, lambda z: F.concat(z["label"], F.lit(". "), z["text"])), "\n")


def choice_question(question: ColumnLike, labels: ColumnLike, texts: ColumnLike) -> Column:
    return F.concat(as_column(question), F.lit("\n\n"), format_choices(labels, texts),
                    F.lit("\n\n" + CHOICE_INSTRUCTION))


def choice_messages(question: ColumnLike, labels: ColumnLike, texts: ColumnLike,
                    mode: ColumnLike) -> Column:
    return chat_messages(choice_question(question, labels, texts), mode)
