"""Shorthands for tests."""

from pyspark.sql import functions as F


def apply(spark, expression, values, name="t"):
    """Values of a column expression over a list of texts, in input order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {name} string").repartition(4)
    out = df.select("i", F.lit(0).alias("_"), expression.alias("r")).orderBy("i").collect()
    return [r["r"] for r in out]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
