"""Comparison of a registered query with its SQL on the small tables."""

import os

import duckdb

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def rows_of_sql(sql, folder=FOLDER):
    connection = duckdb.connect()
    for file in os.listdir(folder):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    done = connection.execute(sql)
    names = [d[0] for d in done.description]
    return canonical(names, done.fetchall())


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


def rows_of_query(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])
