"""Hot keys: the salted and sliced paths give the same rows as the plain ones."""

import random

import pytest
from pyspark.sql import Window, functions as F

from gradeframe.operators import layout, rollouts, skew
from helpers import rows


@pytest.fixture(scope="module")
def lopsided(spark):
    """Key 7 holds a third of all rows, NULL is a key too."""
    draw = random.Random(5)
    data = [(7 if draw.random() < 1 / 3 else draw.choice([None, *range(300)]), draw.random(),
             draw.randrange(10), i) for i in range(6000)]
    return spark.createDataFrame(data, "key long, x double, y int, id long").repartition(5).cache()


def test_hot_keys_are_found(lopsided):
    hot = skew.hot_keys(lopsided, ["key"], min_rows=100)
    assert len(hot) == 1 and hot[0].rows > 1800 and hot[0].splits >= 18
    assert skew.hot_keys(lopsided, ["key"]) == []


@pytest.mark.parametrize("order", [["x", "id"], ["y", "x", "id"], ["id"]])
def test_positions(lopsided, order):
    sliced = skew.with_position(lopsided, ["key"], order, "pos", min_rows=100)
    plain = lopsided.withColumn(
        "pos", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("long"))
    assert sliced.columns == plain.columns
    assert rows(sliced) == rows(plain)


def test_positions_do_not_sort_a_hot_group_in_one_task(lopsided):
    hot = skew.hot_keys(lopsided, ["key"], min_rows=100)
    sliced = skew._with_slice(lopsided, ["key"], ["x", "id"], hot)
    sizes = [r["count"] for r in sliced.groupBy("key", skew._SLICE).count().where("key = 7").collect()]
    assert len(sizes) >= 15 and max(sizes) < 400


def test_hot_limit_does_not_grow_with_the_data(lopsided):
    """With four times the rows the same keys are above the same limit, and small ones never are."""
    four = lopsided.unionByName(lopsided).unionByName(lopsided).unionByName(lopsided)
    limit = 400
    sizes = {r["key"]: r["count"] for r in four.groupBy("key").count().collect()}
    hot = skew.hot_keys(four, ["key"], min_rows=limit)
    assert len(hot) == sum(n > limit for n in sizes.values()) and all(h.rows > limit for h in hot)
    assert all(h.rows / h.splits <= limit for h in hot)


def test_advantage_paths_agree(lopsided):
    rewarded = lopsided.withColumn("reward", (F.col("y") > 5).cast("double"))
    variants = [
        rollouts.group_advantage(rewarded, ["key"], bounded=True),
        rollouts.group_advantage(rewarded, ["key"]),
        rollouts.group_advantage(rewarded, ["key"], min_rows=100),
    ]
    first, *others = [{r["id"]: r["advantage"] for r in v.collect()} for v in variants]
    for other in others:
        assert other == pytest.approx(first)


def test_an_example_is_one_row_whatever_its_size(lopsided):
    numbered = skew.with_position(lopsided, ["key"], ["id"], "sample_idx")
    lists = layout.collect_samples(numbered, ["key"], "y", "ys")
    assert lists.count() == numbered.select("key").distinct().count()
    back = lists.select("key", F.posexplode("ys").alias("i", "y"))
    assert rows(back) == rows(numbered.select("key", "sample_idx", "y"))


def test_ranges_without_long_arrays(spark):
    df = spark.createDataFrame([(1, 10), (2, 0), (3, 1), (4, 9000)], "id int, last long")
    got = layout.explode_range(df, "last", "k", block=4).groupBy("id").agg(
        F.count("k"), F.min("k"), F.max("k"), F.count_distinct("k"))
    assert rows(got) == [(1, 10, 1, 10, 10), (3, 1, 1, 1, 1), (4, 9000, 1, 9000, 9000)]
    wide = layout.explode_range(df, "last", "k", block=4, spread=True)
    assert rows(wide.groupBy("id").agg(F.count("k"), F.min("k"), F.max("k"), F.count_distinct("k"))) == rows(got)
    per_task = wide.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 4500
    zero = layout.explode_range(df, "last", "k", first=0, block=4).groupBy("id").agg(F.count("k"))
    assert rows(zero) == [(1, 11), (2, 1), (3, 2), (4, 9001)]
