"""Queries over choice rollouts: letters, votes, accuracies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.catalog import oracle
from gradeframe.catalog.math_queries import ROW, rounded
from gradeframe.catalog.registry import query
from gradeframe.catalog.rollouts import CHOICE_SQL, choice_rollouts
from gradeframe.functions.choice import DEFAULT_LABELS
from gradeframe.operators import extraction, voting
from gradeframe.plans import choice_eval
from gradeframe.sources.tables import spread, table

_CHOSEN = f"(SELECT *, {oracle.choice('output', 'labels')} AS choice FROM {CHOICE_SQL})"
_COUNTS = """count(*) AS total,
  count(*) FILTER (WHERE first_right) AS pass_at_1, count(*) FILTER (WHERE any_right) AS pass_at_k,
  count(*) FILTER (WHERE majority_right) AS majority_vote_correct,
  count(*) FILTER (WHERE extracted) AS extraction_success"""
_RATES = """round(pass_at_1 / total, 6) AS pass_at_1_rate, round(pass_at_k / total, 6) AS pass_at_k_rate,
  round(majority_vote_correct / total, 6) AS majority_vote_rate,
  round(extraction_success / total, 6) AS extraction_rate"""


def _winners(*keys: str) -> str:
    listed = ", ".join(keys)
    return f"""(SELECT {listed}, choice AS winner, votes FROM (
      SELECT *, row_number() OVER (PARTITION BY {listed} ORDER BY votes DESC, first_at) AS rank
      FROM (SELECT {listed}, choice, count(*) AS votes, min(sample_idx) AS first_at
        FROM {_CHOSEN} GROUP BY {listed}, choice)) WHERE rank = 1)"""


def _votes(*keys: str) -> str:
    listed = ", ".join(keys)
    same = " AND ".join(f"e.{k} = w.{k}" for k in keys)
    return f"""(SELECT e.*, w.winner IS NOT DISTINCT FROM e.answer_key AS majority_right
      FROM (SELECT {listed}, answer_key, bool_or(choice IS NOT DISTINCT FROM answer_key) AS any_right,
          bool_or(choice IS NOT NULL) AS extracted,
          bool_or(choice IS NOT DISTINCT FROM answer_key AND sample_idx = first_at) AS first_right
        FROM (SELECT *, min(sample_idx) OVER (PARTITION BY {listed}) AS first_at FROM {_CHOSEN})
        GROUP BY {listed}, answer_key) e
      JOIN {_winners(*keys)} w ON {same})"""


def _chosen(spark: SparkSession, folder: str, positions: bool = True) -> DataFrame:
    return extraction.extract_choices(choice_rollouts(spark, folder, positions), labels="labels")


@query(f"SELECT {', '.join(ROW)}, choice FROM {_CHOSEN}")
def choice_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _chosen(spark, folder, positions=False).select(*ROW, "choice")


@query(f"""SELECT conv_id, turn, {oracle.choice('text', 'labels')} AS choice
  FROM (SELECT *, ['A', 'B', 'C', 'D', 'E'] AS labels FROM conversations)
  WHERE role = 'assistant'""")
def choice_extract_conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = (table(spark, folder, "conversations").where("role = 'assistant'")
             .select("conv_id", "turn", "text"))
    return extraction.extract_choices(spread(turns, "conv_id"), "text").select(
        "conv_id", "turn", "choice")


@query(f"""SELECT doc_id, {oracle.choice('text', 'labels')} AS choice
  FROM (SELECT *, ['A', 'B', 'C', 'D', 'E'] AS labels FROM documents)""")
def choice_extract_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return extraction.extract_choices(documents, "text").select("doc_id", "choice")


@query(f"""SELECT *, {_RATES} FROM (SELECT benchmark, {_COUNTS}
  FROM {_votes('benchmark', 'example_id')} GROUP BY benchmark)""")
def choice_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    table_ = voting.choice_accuracy(_chosen(spark, folder), ["benchmark"], ["example_id"],
                                    labels=DEFAULT_LABELS)
    return table_.withColumns(rounded(*voting.RATES))


@query(f"""SELECT w.example_id, w.winner, w.votes, s.samples FROM {_winners('example_id')} w
  JOIN (SELECT example_id, count(*) AS samples FROM {_CHOSEN} GROUP BY example_id) s
  USING (example_id)""")
def majority_vote(spark: SparkSession, folder: str) -> DataFrame:
    votes = voting.majority_vote(_chosen(spark, folder), ["example_id"], labels=DEFAULT_LABELS)
    return votes.withColumn("samples", F.col("samples").cast("long"))


@query(f"""SELECT *, {_RATES} FROM (SELECT benchmark, step, {_COUNTS}
  FROM {_votes('benchmark', 'step', 'example_id')} GROUP BY benchmark, step)""")
def checkpoint_curve(spark: SparkSession, folder: str) -> DataFrame:
    curve = choice_eval.checkpoint_curve(_chosen(spark, folder), ["example_id"],
                                         ["benchmark", "step"], labels=DEFAULT_LABELS)
    return curve.withColumns(rounded(*voting.RATES))


@query(f"""SELECT benchmark, total, pass_at_1, pass_at_k, majority_vote_correct, extraction_success, {_RATES}
  FROM (SELECT i.benchmark, count(*) AS total, count(*) FILTER (WHERE first_right) AS pass_at_1,
      count(*) FILTER (WHERE any_right) AS pass_at_k,
      count(*) FILTER (WHERE majority_right) AS majority_vote_correct,
      count(*) FILTER (WHERE extracted) AS extraction_success
    FROM (SELECT CASE o_orderkey % 2 WHEN 0 THEN 'choice_a' ELSE 'choice_b' END AS benchmark,
        o_orderkey AS example_id FROM orders
      UNION ALL SELECT 'choice_none', c_custkey FROM customer) i
    LEFT JOIN {_votes('benchmark', 'example_id')} v USING (benchmark, example_id) GROUP BY i.benchmark)""")
def choice_accuracy_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items without any sample count in the total, also if they are a whole benchmark."""
    items = table(spark, folder, "orders").selectExpr(
        "CASE o_orderkey % 2 WHEN 0 THEN 'choice_a' ELSE 'choice_b' END AS benchmark",
        "o_orderkey AS example_id").unionByName(table(spark, folder, "customer").selectExpr(
            "'choice_none' AS benchmark", "c_custkey AS example_id"))
    counted = voting.choice_accuracy(_chosen(spark, folder), ["benchmark"], ["example_id"], items=items)
    return counted.withColumns(rounded(*voting.RATES))
