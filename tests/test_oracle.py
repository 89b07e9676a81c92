"""Every registered query against DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from gradeframe.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{file}'")
    return connection


def clean(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(clean(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    columns, rows = canonical(result.columns, [tuple(r) for r in result.collect()])
    expected = duck.execute(ORACLES[name])
    want_columns, want = canonical([d[0] for d in expected.description], expected.fetchall())
    assert columns == want_columns
    assert len(rows) == len(want)
    different = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not different, different[:3]
