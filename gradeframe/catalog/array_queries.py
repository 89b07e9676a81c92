"""Queries in array layout: one row per example, samples side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.catalog import oracle
from gradeframe.catalog.math_queries import rounded
from gradeframe.catalog.registry import query
from gradeframe.operators import extraction, voting
from gradeframe.sources.tables import spread, table

# Column name -> expression, valid in both SQL dialects.
_PARTS = {
    "o_orderkey": "o_orderkey",
    "benchmark": "o_orderpriority",
    "answer_key": "substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1)",
    "x": "substr('ABCDE', CAST(o_custkey % 5 + 1 AS INT), 1)",
    "y": "substr('ABCDE', CAST(o_custkey % 7 % 5 + 1 AS INT), 1)",
    "v": "CAST(o_custkey % 9 AS STRING)",
}
_CHOICE_TEXTS = ("'The answer is (' || x || ').'", "lower(y) || ') since ' || o_orderstatus",
                 "'not sure'", "'Choice ' || y")
_MATH_TEXTS = ("chr(92) || 'boxed{' || v || '}'", "'Answer: ' || v || '.5'", "'it is ' || v",
               "o_orderstatus || chr(10) || '  ' || benchmark || ' '")


def _examples(spark: SparkSession, folder: str, texts: tuple[str, ...]) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                                   "o_orderstatus")
    named = [f"{e} AS {n}" for n, e in _PARTS.items()]
    size = "CAST(o_custkey % 5 AS INT)"
    return (spread(orders, "o_orderkey").selectExpr(*named, "o_orderstatus", f"{size} AS k")
            .selectExpr("o_orderkey", "benchmark", "answer_key",
                        f"slice(array({', '.join(texts)}), 1, k) AS outputs"))


def _samples_sql(texts: tuple[str, ...], answer: str) -> str:
    named = ", ".join(f"{e} AS {n}" for n, e in _PARTS.items())
    return f"""(SELECT *, {answer} AS found FROM (
      SELECT *, ['A', 'B', 'C', 'D', 'E'] AS labels, unnest([{', '.join(texts)}][1:k]) AS output,
        unnest(range(0, k)) AS i
      FROM (SELECT {named}, o_orderstatus, CAST(o_custkey % 5 AS INT) AS k FROM orders)))"""


@query(f"""SELECT o_orderkey, coalesce(predicted, '') AS predicted FROM orders LEFT JOIN (
    SELECT o_orderkey, string_agg(found, '|' ORDER BY i) AS predicted
    FROM {_samples_sql(_MATH_TEXTS, oracle.answer('output'))} GROUP BY o_orderkey)
  USING (o_orderkey)""")
def extract_answer_arrays(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract_answer_arrays(_examples(spark, folder, _MATH_TEXTS))
    return found.select("o_orderkey", F.array_join("predicted_answers", "|").alias("predicted"))


_FOUND = _samples_sql(_CHOICE_TEXTS, oracle.choice("output", "labels"))
_COUNTED = f"""(SELECT o_orderkey, found, count(*) AS votes, min(i) AS first_at FROM {_FOUND}
  GROUP BY o_orderkey, found)"""


@query(f"""SELECT benchmark, total, pass_at_1, pass_at_k, majority_vote_correct, extraction_success,
    round(pass_at_1 / total, 6) AS pass_at_1_rate, round(pass_at_k / total, 6) AS pass_at_k_rate,
    round(majority_vote_correct / total, 6) AS majority_vote_rate,
    round(extraction_success / total, 6) AS extraction_rate
  FROM (SELECT benchmark, count(*) AS total, count(*) FILTER (WHERE first_key) AS pass_at_1,
      count(*) FILTER (WHERE any_key) AS pass_at_k, count(*) FILTER (WHERE top_key) AS majority_vote_correct,
      count(*) FILTER (WHERE any_found) AS extraction_success
    FROM (SELECT o.o_orderpriority AS benchmark, s.first_key, s.any_key, s.any_found, w.top_key
      FROM orders o LEFT JOIN (
        SELECT o_orderkey, bool_or(i = 0 AND found IS NOT DISTINCT FROM answer_key) AS first_key,
          bool_or(found IS NOT DISTINCT FROM answer_key) AS any_key, bool_or(found IS NOT NULL) AS any_found
        FROM {_FOUND} GROUP BY o_orderkey) s USING (o_orderkey)
      LEFT JOIN (SELECT o_orderkey,
          found IS NOT DISTINCT FROM substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1) AS top_key
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY votes DESC, first_at) AS rank
          FROM {_COUNTED}) WHERE rank = 1) w USING (o_orderkey))
    GROUP BY benchmark)""")
def choice_accuracy_arrays(spark: SparkSession, folder: str) -> DataFrame:
    results = extraction.extract_choice_arrays(_examples(spark, folder, _CHOICE_TEXTS))
    return voting.array_accuracy(results, ["benchmark"]).withColumns(rounded(*voting.RATES))
