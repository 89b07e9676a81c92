"""Mixture schedule, mixed groups, advantages, curves and published deltas."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import curves, rollouts
from helpers import rows


def test_schedule(spark):
    got = rollouts.mixture_schedule(spark, 7, 5, 8).orderBy("step").collect()
    assert [r["explorer_quota"] for r in got] == [8, 6, 4, 2, 0, 0, 0]
    assert all(r["explorer_quota"] + r["learner_quota"] == 8 for r in got)
    one = rollouts.mixture_schedule(spark, 3, 1, 8).orderBy("step").collect()
    assert [r["explorer_quota"] for r in one] == [8, 0, 0]
    # 0.7 * 10 is 7.000000000000001 in floating point and must stay 7.
    tenth = rollouts.mixture_schedule(spark, 11, 11, 10).orderBy("step").collect()
    assert [r["explorer_quota"] for r in tenth] == list(range(10, -1, -1))


@pytest.fixture(scope="module")
def pool(spark):
    draw = random.Random(2)
    data = [(step, q, source, i, float(draw.random() < 0.4)) for step in range(1, 8) for q in range(5)
            for source in ("explorer", "learner") for i in range(12)]
    return spark.createDataFrame(
        data, "step int, question int, source string, sample_idx int, reward double").repartition(6).cache()


@pytest.mark.parametrize("seed", [None, 11])
def test_mixed_group(pool, seed):
    mixed = rollouts.mixed_group(pool, ["step", "question"], ["sample_idx"], 5, 8, seed=seed).collect()
    quota = {1: 8, 2: 6, 3: 4, 4: 2}
    for step in range(1, 8):
        for q in range(5):
            group = [r for r in mixed if (r["step"], r["question"]) == (step, q)]
            explorers = sorted(r["sample_idx"] for r in group if r["source"] == "explorer")
            assert len(group) == 8 and len(explorers) == quota.get(step, 0)
            if seed is None:
                assert explorers == list(range(quota.get(step, 0)))
    assert len(mixed) == 7 * 5 * 8


def test_surplus_is_dropped_before_the_shuffle(pool):
    mixed = rollouts.mixed_group(pool, ["step", "question"], ["sample_idx"], 5, 8)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 8, Partial" in plan


@pytest.mark.parametrize("std", ["pop", "samp"])
def test_advantage(pool, std):
    got = rollouts.group_advantage(pool, ["step", "question"], std=std).collect()
    for step in range(1, 8):
        for q in range(5):
            group = [r for r in got if (r["step"], r["question"]) == (step, q)]
            rewards = [r["reward"] for r in group]
            spread = (statistics.pstdev if std == "pop" else statistics.stdev)(rewards)
            mean = statistics.mean(rewards)
            assert sum(r["advantage"] for r in group) == pytest.approx(0, abs=1e-9)
            for r in group:
                assert r["advantage"] == pytest.approx((r["reward"] - mean) / spread if spread else 0)


def test_flat_and_single_groups(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.1), (1, 0.1), (2, 1.0)], "g int, reward double")
    for std in ("pop", "samp"):
        assert {r["advantage"] for r in rollouts.group_advantage(df, ["g"], std=std).collect()} == {0.0}
    with pytest.raises(ValueError):
        rollouts.group_advantage(df, ["g"], std="mad")


def test_crossover(spark):
    curve = spark.createDataFrame(
        [(m, b, k, v) for b in ("x", "y") for k in (1, 2, 4) for m, v in
         (("small", {"x": k * 0.2, "y": 0.1}[b]), ("large", 0.3))] + [("small", "x", 8, 1.0)],
        "model string, benchmark string, k int, pass_at_k double")
    got = curves.crossover(curve, "small", "large").select(
        "benchmark", "crossover_k", "ks_ahead", "ks_compared")
    assert rows(got) == [("x", 2, 2, 3), ("y", None, 0, 3)]


# Published Pass@1 in percent: learner, benchmark, method, value, printed gain.
PUBLISHED = [
    ("8B", "aime24", "baseline", 15.0, None), ("8B", "aime25", "baseline", 12.1, None),
    ("8B", "aime24", "1.7B explorer", 23.8, 8.8), ("8B", "aime25", "1.7B explorer", 22.5, 10.4),
    ("14B", "aime24", "baseline", 18.0, None), ("14B", "aime25", "baseline", 12.9, None),
    ("14B", "aime24", "4B explorer", 24.4, 6.4), ("14B", "aime25", "4B explorer", 14.6, 1.7),
    ("8B", "csqa", "baseline", 63.9, None), ("8B", "csqa", "4B explorer", 67.8, 3.9),
    ("14B", "csqa", "baseline", 67.2, None), ("14B", "csqa", "4B explorer", 70.7, 3.5),
]


def test_published_deltas(spark):
    table = spark.createDataFrame(
        PUBLISHED, "learner string, benchmark string, method string, value double, printed double")
    deltas = curves.delta_to_baseline(table, "baseline", ["learner", "benchmark"])
    for r in deltas.collect():
        assert r["delta"] == pytest.approx(r["printed"])
    means = curves.mean_delta(deltas.where("learner = '8B' AND benchmark <> 'csqa'")).first()
    assert means["mean_delta"] == pytest.approx(9.6) and means["compared"] == 2


def test_step_change(spark):
    curve = spark.createDataFrame([(10, 0.5), (2, 0.2), (1, 0.1)], "step int, v double")
    got = curves.step_delta(curve, "v").select("step", F.round("change", 6))
    assert rows(got) == [(1, None), (10, 0.3), (2, 0.1)]
