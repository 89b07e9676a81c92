"""Pass@k against exact arithmetic, and the aggregations built on it."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import passk
from gradeframe.operators import scoring
from helpers import rows


def exact(n, c, k):
    if n <= 0 or c <= 0 or k <= 0:
        return 0.0
    k = min(k, n)
    if k > n - c:
        return 1.0
    return float(1 - Fraction(math.comb(n - c, k), math.comb(n, k)))


def values(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n long, c long, k long")
    return [r[0] for r in df.orderBy("i").select(passk.pass_at_k("n", "c", "k")).collect()]


def test_boundaries(spark):
    cases = [(10, 10, 1), (10, 10, 7), (10, 0, 1), (10, 0, 7), (10, 1, 5), (10, 7, 4), (20, 6, 6),
             (5, 2, 10), (1, 1, 1), (1, 0, 1), (0, 0, 1), (4, 2, 0), (4, 2, -1)]
    want = [1, 1, 0, 0, 0.5, 1, 0.9225232198142415, 1, 1, 0, 0, 0, 0]
    assert values(spark, cases) == pytest.approx(want, abs=1e-12)


def test_all_small_cases_exactly(spark):
    cases = [(n, c, k) for n in range(0, 25) for c in range(0, n + 1) for k in range(0, n + 2)]
    assert values(spark, cases) == pytest.approx([exact(*c) for c in cases], abs=1e-13)


def test_large_counts(spark):
    cases = [(1000, 70, 80), (1000, 65, 65), (10_000, 100, 100), (10_000, 66, 9000), (5000, 2500, 70),
             (100_000, 70, 1000), (2000, 65, 1930), (200, 65, 135), (200, 65, 134)]
    assert values(spark, cases) == pytest.approx([exact(*c) for c in cases], abs=1e-11)
    # An example holding billions of samples costs no more than a small one.
    huge = values(spark, [(3 * 10**10, 10**6, 10**4), (3 * 10**10, 10**6, 1), (3 * 10**10, 5, 10**9)])
    assert huge == pytest.approx([1 - math.exp(10**4 * math.log1p(-10**6 / 3e10)), 1 / 3e4,
                                  1 - (1 - 1 / 30)**5], rel=1e-6)


def test_monotone_and_mean(spark):
    curve = values(spark, [(12, 3, k) for k in range(1, 13)])
    assert curve == sorted(curve) and curve[0] == pytest.approx(3 / 12)
    assert values(spark, [(12, c, 4) for c in range(13)]) == sorted(
        values(spark, [(12, c, 4) for c in range(13)]))


def test_binomial(spark):
    cases = [(n, k) for n in range(-1, 20) for k in range(-1, 21)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, k int")
    got = [r[0] for r in df.orderBy("i").select(passk.binomial("n", "k")).collect()]
    assert got == [math.comb(n, k) if 0 <= k <= n else 0 for n, k in cases]


def judged(spark, examples):
    data = [("b", e, i, p, g) for e, (g, preds) in enumerate(examples) for i, p in enumerate(preds)]
    df = spark.createDataFrame(
        data, "benchmark string, example_id long, sample_idx int, answer_text string, gold string")
    return scoring.judge(df)


KEYS = ["benchmark", "example_id"]


def test_per_example(spark):
    scores = scoring.example_scores(judged(spark, [
        ("42", ["42", "43", "42", "44", "42"]), ("42", ["ok", "good", "42", "x", "y", "42"]),
        ("42", ["a", "b", "c", "d"])]), KEYS)
    got = {(r["example_id"], r["k"]): r["pass_at_k"]
           for r in scoring.example_pass_at_k(scores).collect()}
    assert len(got) == 15
    assert got[0, 1] == pytest.approx(0.6) and got[0, 5] == 1.0
    assert got[1, 2] == pytest.approx(1 - 6 / 15)
    assert all(got[2, k] == 0 for k in range(1, 5))


def test_benchmark(spark):
    scores = scoring.example_scores(judged(spark, [
        ("42", ["42", "42", "43"]), ("100", ["100", "99", "100"]), ("50%", ["0.5", "1/2", "0.49"])]),
        KEYS)
    summary = scoring.benchmark_summary(scores).withColumn("ks", F.map_keys("pass_at_k")).collect()
    assert len(summary) == 1
    row = summary[0]
    assert (row["total_examples"], row["correct_at_least_once"], row["accuracy_any"]) == (3, 3, 1.0)
    assert row["ks"] == ["pass@1", "pass@2", "pass@3"]
    assert row["pass_at_k"]["pass@1"] == pytest.approx(2 / 3)
    quick = scoring.quick_results(scoring.benchmark_summary(scores)).first()
    assert quick["pass_at_1"] == pytest.approx(2 / 3)


def scores_of(spark, triples):
    return spark.createDataFrame([("b", *t) for t in triples],
                                 "benchmark string, example_id long, n long, c long")


def test_ks_follow_the_first_example(spark):
    scores = scores_of(spark, [(0, 0, 0), (1, 3, 1), (2, 5, 5)])
    got = {r["k"]: r["pass_at_k"] for r in scoring.pass_at_k_by(scores).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[2] == pytest.approx((exact(3, 1, 2) + 1) / 2)
    summary = scoring.benchmark_summary(scores).first()
    assert summary["total_examples"] == 3 and summary["correct_at_least_once"] == 2


def test_short_examples(spark):
    scores = scores_of(spark, [(0, 4, 2), (1, 2, 1)])
    with pytest.raises(Exception, match="only 2 samples"):
        scoring.pass_at_k_by(scores).collect()
    with pytest.raises(Exception, match="only 2 samples"):
        scoring.benchmark_summary(scores).collect()
    drop = {r["k"]: r["pass_at_k"] for r in scoring.pass_at_k_by(scores, on_short="drop").collect()}
    clamp = {r["k"]: r["pass_at_k"] for r in scoring.pass_at_k_by(scores, on_short="clamp").collect()}
    assert drop[4] == pytest.approx(exact(4, 2, 4)) and drop[1] == pytest.approx(0.5)
    assert clamp[4] == pytest.approx((exact(4, 2, 4) + exact(2, 1, 2)) / 2)
    with pytest.raises(ValueError):
        scoring.pass_at_k_by(scores, on_short="ignore")


def test_only_empty_examples(spark):
    for ks in (None, [1, 2]):
        row = scoring.benchmark_summary(scores_of(spark, [(0, 0, 0), (1, 0, 0)]), ks=ks).first()
        assert (row["total_examples"], row["accuracy_any"], row["pass_at_k"]) == (2, 0.0, {})


def test_no_group_columns(spark):
    scores = scores_of(spark, [(0, 2, 1), (1, 2, 2)])
    got = {r["k"]: r["pass_at_k"] for r in scoring.pass_at_k_by(scores, []).collect()}
    assert got == pytest.approx({1: 0.75, 2: 1.0})
    assert scoring.benchmark_summary(scores, []).first()["total_examples"] == 2


def test_map_keeps_numeric_order(spark):
    scores = scores_of(spark, [(0, 12, 3)])
    table = scoring.pass_at_k_map(scoring.pass_at_k_by(scores))
    assert table.select(F.map_keys("pass_at_k")).first()[0] == [f"pass@{k}" for k in range(1, 13)]


def test_accuracy_of_nothing(spark):
    empty = scores_of(spark, [(0, 1, 1)]).where("n > 5")
    assert rows(scoring.accuracy_any(empty, [])) == [(0, 0, 0.0)]


def test_formats(spark):
    row = spark.range(1).select(passk.percent_text(F.lit(0.12345)).alias("p"),
                                passk.score_text(F.lit(0.6)).alias("s")).first()
    assert (row["p"], row["s"]) == ("12.35%", "0.6000") or row["p"] == "12.34%"
