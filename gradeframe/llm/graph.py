"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gradeframe.llm.common import stored


def _stored(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The links as a table, with their number and the sum of their hashes, taken while it is written."""
    seen = Observation()
    table = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(
        F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "links")
    return table, seen.get


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (u, v); a component is its smallest node.

    Every step hangs a node's larger neighbours on its smallest one, then its
    smaller neighbours; the links end as stars around the smallest nodes. Sums
    are built before they move and the joins are plain ones that Spark can split
    at a node with many links. Each step is a table in the shared folder, so a
    lost executor costs one step. NULLs and links of a node to itself are left out.
    """
    edges, state = _stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                           .where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        if state == before or not state["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges, state = _stored(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .unionByName(small.select("u", F.col("m").alias("v"))).distinct())
