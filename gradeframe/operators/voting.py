"""Multiple-choice statistics: first sample, any sample, majority, extraction rate.

The samples of an example are first reduced to one row per distinct answer with
its count and first position. That step combines on the map side, so a group of
any size shrinks to the number of labels before it moves. Where the possible
answers are known and few (``labels``), an example is one row of counts and
first positions from the start: one hash aggregate, one exchange, no sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

# More than any sample position, so that a vote outweighs all of them.
_VOTE = Decimal(10 ** 18)

COUNTS = ("total", "pass_at_1", "pass_at_k", "majority_vote_correct", "extraction_success")
RATES = {
    "pass_at_1_rate": "pass_at_1",
    "pass_at_k_rate": "pass_at_k",
    "majority_vote_rate": "majority_vote_correct",
    "extraction_rate": "extraction_success",
}


def answer_counts(samples: DataFrame, keys: Sequence[str], answer: str = "choice",
                  position: str = "sample_idx") -> DataFrame:
    """Votes and first position of each distinct answer, NULL included."""
    return samples.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("votes"),
                                              F.min(position).alias("first_position"))


def _place(answer: Column, labels: Sequence[str]) -> Column:
    """0 for NULL, 1.. for the labels in their order, -1 for anything else."""
    place = F.array_position(F.array(*[F.lit(label) for label in labels]), answer)
    return F.when(answer.isNull(), 0).when(place > 0, place).otherwise(-1).cast("int")


def label_votes(samples: DataFrame, keys: Sequence[str], labels: Sequence[str],
                answer: str = "choice", position: str = "sample_idx") -> DataFrame:
    """Per example an array ``votes`` of (votes, order, place), one item per label that was given.

    ``order`` is the negated first position and ``place`` that of ``_place``.
    All buffers are numbers of a fixed width, so partial counts merge by hash
    whatever the number of samples. An answer that is not among the labels is an
    error.
    """
    places = range(len(labels) + 1)
    counts = [F.count_if(F.col("__place") == i).alias(f"__n{i}") for i in places]
    firsts = [F.min(F.when(F.col("__place") == i, F.col(position))).alias(f"__f{i}") for i in places]
    given = [F.when(F.col(f"__n{i}") > 0, F.struct(F.col(f"__n{i}").alias("votes"), (-F.col(f"__f{i}")).alias("order"),
                                                  F.lit(i).alias("place"))) for i in places]
    unknown = F.when(F.col("__other") > 0, F.raise_error(F.lit(
        f"an answer is none of the labels {', '.join(labels)}")).cast("boolean")).otherwise(F.lit(True))
    return (samples.withColumn("__place", _place(F.col(answer), labels)).groupBy(*keys)
            .agg(*counts, *firsts, F.count_if(F.col("__place") < 0).alias("__other"))
            .where(unknown).select(*keys, F.filter(F.array(*given), lambda v: v.isNotNull()).alias("votes")))


def _label_majority(samples, keys, labels, answer, position):
    top = F.array_max("votes")
    total = F.aggregate("votes", F.lit(0).cast("long"), lambda n, v: n + v["votes"])
    return (label_votes(samples, keys, labels, answer, position)
            .select(*keys, top.alias("__top"), total.alias("samples"))
            .select(*keys, F.get(F.array(*[F.lit(label) for label in labels]), F.col("__top.place") - 1).alias("winner"),
                    F.col("__top.votes").alias("votes"), "samples"))


def majority_vote(samples: DataFrame, keys: Sequence[str], answer: str = "choice",
                  position: str = "sample_idx", labels: Sequence[str] | None = None) -> DataFrame:
    """Most frequent answer of each example; ties go to the answer seen first.

    NULL is a candidate like any other. ``labels`` names all possible answers,
    if they are few; any other answer is an error then.
    """
    if labels is not None:
        return _label_majority(samples, keys, labels, answer, position)
    ranked = F.struct(F.col("votes"), (-F.col("first_position")).alias("order"),
                      F.col(answer).alias("winner"))
    return (answer_counts(samples, keys, answer, position)
            .groupBy(*keys)
            .agg(F.max(ranked).alias("__top"), F.sum("votes").alias("samples"))
            .select(*keys, F.col("__top.winner").alias("winner"),
                    F.col("__top.votes").alias("votes"), "samples"))


def _label_example_votes(samples, keys, key, labels, answer, position):
    right = _place(F.col(key), labels)
    earliest = F.array_max(F.transform("votes", lambda v: F.struct(v["order"], v["place"])))
    return (label_votes(samples, [*keys, key], labels, answer, position)
            .select(*keys, "votes", right.alias("__right"), earliest["place"].alias("__first"),
                    F.array_max("votes")["place"].alias("__top"))
            .select(*keys, (F.col("__first") == F.col("__right")).alias("first_right"),
                    F.exists("votes", lambda v: v["place"] == F.col("__right")).alias("any_right"),
                    (F.col("__top") == F.col("__right")).alias("majority_right"),
                    F.exists("votes", lambda v: v["place"] > 0).alias("extracted")))


def example_votes(samples: DataFrame, keys: Sequence[str], key: str = "answer_key",
                  answer: str = "choice", position: str = "sample_idx",
                  labels: Sequence[str] | None = None) -> DataFrame:
    """Per example: first sample right, any right, majority right, any extracted.

    ``labels`` as in ``majority_vote``.
    """
    if labels is not None:
        return _label_example_votes(samples, keys, key, labels, answer, position)
    # Votes, then position, then the verdict as the last binary digit of one number,
    # because numbers can be aggregated by hash and structs only by sorting.
    right = F.col("__right").cast("int")
    position_ = F.col("first_position").cast("decimal(18,0)")
    ranked = (F.col("votes").cast("decimal(16,0)") * _VOTE - position_) * 2 + right
    earliest = F.col("first_position").cast("decimal(18,0)") * 2 + right
    return (answer_counts(samples, [*keys, key], answer, position)
            .withColumn("__right", F.col(answer).eqNullSafe(F.col(key)))
            .groupBy(*keys)
            .agg(F.min(earliest).alias("__first"), F.max(ranked).alias("__top"),
                 F.bool_or("__right").alias("any_right"),
                 F.bool_or(F.col(answer).isNotNull()).alias("extracted"))
            .select(*keys, (F.col("__first") % 2 != 0).alias("first_right"), "any_right",
                    (F.col("__top") % 2 != 0).alias("majority_right"), "extracted"))


def rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        name: F.coalesce(F.try_divide(F.col(count), F.col("total")), F.lit(0.0))
        for name, count in RATES.items()})


def choice_accuracy(samples: DataFrame, by: Sequence[str], keys: Sequence[str],
                    key: str = "answer_key", answer: str = "choice",
                    position: str = "sample_idx", items: DataFrame | None = None,
                    labels: Sequence[str] | None = None) -> DataFrame:
    """The nine statistics per ``by`` group.

    ``items`` lists all questions; those without samples count in the total.
    ``labels`` as in ``majority_vote``.
    """
    all_keys = list(dict.fromkeys([*by, *keys]))
    votes = example_votes(samples, all_keys, key, answer, position, labels)
    if items is not None:
        votes = items.select(*all_keys).join(votes, all_keys, "left")
    counts = votes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("first_right").alias("pass_at_1"),
        F.count_if("any_right").alias("pass_at_k"),
        F.count_if("majority_right").alias("majority_vote_correct"),
        F.count_if("extracted").alias("extraction_success"))
    return rates(counts)


# The same measures in array layout, one row per example and no shuffle.

def first_right(answers: Column, key: Column) -> Column:
    return (F.size(answers) > 0) & F.get(answers, F.lit(0)).eqNullSafe(key)


def any_right(answers: Column, key: Column) -> Column:
    return F.exists(answers, lambda a: a.eqNullSafe(key))


def any_extracted(answers: Column) -> Column:
    return F.exists(answers, lambda a: a.isNotNull())


def array_majority(answers: Column) -> Column:
    """Struct (votes, order, winner) of the majority answer, NULL for no samples.

    Distinct answers keep the order of their first appearance, which is the
    order in which ties are resolved.
    """
    return F.array_max(F.transform(F.array_distinct(answers), lambda a, i: F.struct(
        F.size(F.filter(answers, lambda x: x.eqNullSafe(a))).alias("votes"),
        (-i).alias("order"), a.alias("winner"))))


def array_accuracy(items: DataFrame, by: Sequence[str], key: str = "answer_key",
                   answers: str = "predicted_answers") -> DataFrame:
    """The nine statistics from array layout; only the final counts are shuffled."""
    given, wanted = F.col(answers), F.col(key)
    majority = (F.size(given) > 0) & array_majority(given)["winner"].eqNullSafe(wanted)
    counts = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(first_right(given, wanted)).alias("pass_at_1"),
        F.count_if(any_right(given, wanted)).alias("pass_at_k"),
        F.count_if(majority).alias("majority_vote_correct"),
        F.count_if(any_extracted(given)).alias("extraction_success"))
    return rates(counts)
