"""Choice statistics: long layout, array layout and a plain count agree."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import layout, voting
from gradeframe.plans import choice_eval
from helpers import rows

MAJORITY = [(["A", "B", "B", "A"], "A"), (["B", "A", "A", "B"], "B"), ([None, None, "A"], None),
            (["C"], "C"), ([None, "A", None, "A"], None)]


def items(spark, answers, keys=None):
    data = [("b", i, (keys or ["A"] * len(answers))[i], list(a)) for i, a in enumerate(answers)]
    return spark.createDataFrame(
        data, "benchmark string, example_id long, answer_key string, predicted array<string>")


def samples(df):
    return layout.explode_samples(df, "predicted", "choice")


def test_majority(spark):
    df = items(spark, [m[0] for m in MAJORITY])
    got = voting.majority_vote(samples(df), ["example_id"]).orderBy("example_id").collect()
    assert [r["winner"] for r in got] == [m[1] for m in MAJORITY]
    top = df.orderBy("example_id").select(voting.array_majority(F.col("predicted"))["winner"])
    assert [r[0] for r in top.collect()] == [m[1] for m in MAJORITY]


def plain(answers, keys):
    counts = Counter()
    for given, key in zip(answers, keys):
        counts["total"] += 1
        if given:
            order = sorted(set(given), key=lambda a: (-given.count(a), given.index(a)))
            counts["pass_at_1"] += given[0] == key
            counts["pass_at_k"] += key in given
            counts["majority_vote_correct"] += order[0] == key
            counts["extraction_success"] += any(a is not None for a in given)
    return [counts[c] for c in voting.COUNTS]


@pytest.mark.parametrize("parts", [1, 8])
def test_statistics(spark, parts):
    draw = random.Random(3)
    answers = [[draw.choice(["A", "B", "C", None]) for _ in range(draw.randrange(0, 7))]
               for _ in range(300)]
    keys = [draw.choice("ABC") for _ in answers]
    df = items(spark, answers, keys).repartition(parts, "example_id")
    shuffled = samples(df).orderBy(F.rand(1)).repartition(parts)
    table = voting.choice_accuracy(shuffled, ["benchmark"], ["example_id"], items=df)
    row = table.first()
    want = plain(answers, keys)
    assert [row[c] for c in voting.COUNTS] == want
    assert row["majority_vote_rate"] == pytest.approx(want[3] / 300)
    answers_, key = F.col("predicted"), F.col("answer_key")
    top = voting.array_majority(answers_)
    arrays = df.agg(F.count("*"), F.count_if(voting.first_right(answers_, key)),
                    F.count_if(voting.any_right(answers_, key)),
                    F.count_if((F.size(answers_) > 0) & top["winner"].eqNullSafe(key)),
                    F.count_if(voting.any_extracted(answers_))).first()
    assert list(arrays) == want


def test_array_statistics_and_results(spark):
    draw = random.Random(8)
    answers = [[draw.choice(["A", "B", None]) for _ in range(draw.randrange(0, 6))] for _ in range(200)]
    keys = [draw.choice("AB") for _ in answers]
    df = items(spark, answers, keys)
    row = voting.array_accuracy(df, ["benchmark"], answers="predicted").first()
    assert [row[c] for c in voting.COUNTS] == plain(answers, keys)


def test_letters_in_both_layouts(spark):
    from gradeframe.operators.extraction import extract_choice_arrays, extract_choices
    from test_choice import GOLDEN
    df = spark.createDataFrame([(0, [c[0] for c in GOLDEN])], "i int, outputs array<string>")
    arrays = extract_choice_arrays(df).first()["predicted_answers"]
    long = extract_choices(layout.explode_samples(df)).orderBy("sample_idx").collect()
    assert arrays == [r["choice"] for r in long] == [c[1] for c in GOLDEN]


def test_null_key_matches_null_answer(spark):
    df = items(spark, [[None, "A"], ["A"], []], [None, None, None])
    row = voting.choice_accuracy(samples(df), ["benchmark"], ["example_id"], items=df).first()
    assert [row[c] for c in voting.COUNTS] == [3, 1, 1, 1, 2]


def test_no_items(spark):
    none = items(spark, [["A"]]).where("example_id > 9")
    row = voting.choice_accuracy(samples(none), [], ["example_id"]).first()
    assert row["total"] == 0 and row["pass_at_1_rate"] == 0.0


def test_raw_to_statistics(spark):
    raw = spark.createDataFrame(
        [("csqa", 0, "A", (["A", "B"], ["x", "y"]), ["The answer is (A).", "b"]),
         ("csqa", 1, "B", (["A", "B"], ["x", "y"]), ["nothing", "(E) [B]"]),
         ("csqa", 2, "B", (["A", "B"], ["x", "y"]), [])],
        "benchmark string, example_id long, answerKey string, "
        "choices struct<label: array<string>, text: array<string>>, outputs array<string>")
    row = choice_eval.score_choice_raw(raw).first()
    assert [row[c] for c in voting.COUNTS] == [3, 1, 2, 1, 2]


def test_checkpoints_in_one_job(spark):
    base = samples(items(spark, [["A", "B"], ["B", "B"]]))
    steps = (base.withColumn("strategy", F.lit("s")).withColumn("step", F.explode(F.array(
        F.lit(10), F.lit(2)))))
    curve = choice_eval.checkpoint_curve(steps, ["example_id"]).orderBy("step")
    assert rows(curve.select("step", "total", "pass_at_1")) == [(10, 2, 1), (2, 2, 1)]
    assert [r["step"] for r in curve.collect()] == [2, 10]


@pytest.mark.parametrize("parts", [1, 8])
def test_known_labels_give_the_same_votes(spark, parts):
    draw = random.Random(5)
    answers = [[draw.choice(["A", "B", "C", None]) for _ in range(draw.randrange(0, 9))] for _ in range(300)]
    keys = [draw.choice(["A", "B", "C", "Z", None]) for _ in answers]
    df = samples(items(spark, answers, keys)).orderBy(F.rand(2)).repartition(parts)
    for make in (voting.majority_vote, voting.example_votes):
        got = make(df, ["example_id"], labels="CAB")
        assert rows(got) == rows(make(df, ["example_id"]).select(*got.columns))
    assert rows(voting.choice_accuracy(df, ["benchmark"], ["example_id"], labels="ABC")) == rows(
        voting.choice_accuracy(df, ["benchmark"], ["example_id"]))


def test_known_labels_need_one_exchange_and_no_sort(spark):
    df = samples(items(spark, [["A", "B"]] * 40)).repartition(4)
    votes = voting.majority_vote(df, ["example_id"], labels="AB")
    votes.collect()
    plan = votes._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortAggregate" not in plan and "Sort [" not in plan
    assert plan.count("Exchange hashpartitioning(example_id") == 1


def test_other_answers_than_the_labels_are_errors(spark):
    with pytest.raises(Exception, match="none of the labels A, B"):
        voting.majority_vote(samples(items(spark, [["A", "C"]])), ["example_id"], labels="AB").collect()


def test_votes_of_a_hot_example(spark):
    df = spark.range(200_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS example_id", "id AS sample_idx",
        "CASE id % 5 WHEN 0 THEN 'A' WHEN 4 THEN NULL ELSE 'B' END AS choice")
    got = voting.majority_vote(df, ["example_id"], labels="AB")
    assert rows(got) == rows(voting.majority_vote(df, ["example_id"]))
