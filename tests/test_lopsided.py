"""Whole queries on tables in which one key holds a third of the rows."""

import os

import duckdb
import pytest

from gradeframe.catalog import ORACLES, QUERIES
from gradeframe.operators import skew
from test_oracle import FOLDER, canonical

CHANGED = {
    "lineitem": "* REPLACE (CASE WHEN hash(l_partkey, l_extendedprice) % 3 = 0 THEN 5 ELSE l_orderkey END"
                " AS l_orderkey, CASE WHEN hash(l_extendedprice) % 3 = 0 THEN 2 ELSE l_suppkey END AS l_suppkey)",
    "events": "* REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)",
}
KEYED = ("predicted_answer_lists", "example_scores", "passk_per_example", "benchmark_summary",
         "passk_first_example_ks", "passk_empty_examples", "choice_accuracy", "majority_vote",
         "checkpoint_curve", "example_advantage", "mixed_group", "group_advantage", "log_tail")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lopsided"))
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        connection.execute(f"COPY (SELECT {CHANGED.get(name, '*')} FROM '{FOLDER}/{file}') "
                           f"TO '{folder}/{file}' (FORMAT parquet)")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{file}'")
    return folder, connection


@pytest.mark.parametrize("name", KEYED)
def test_hot_key(spark, tables, monkeypatch, name):
    monkeypatch.setattr(skew, "HOT_ROWS", 200)
    folder, connection = tables
    result = QUERIES[name](spark, folder)
    columns, rows = canonical(result.columns, [tuple(r) for r in result.collect()])
    expected = connection.execute(ORACLES[name])
    want_columns, want = canonical([d[0] for d in expected.description], expected.fetchall())
    assert columns == want_columns and len(rows) == len(want)
    different = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not different, different[:3]
