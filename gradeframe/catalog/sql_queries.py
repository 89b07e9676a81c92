"""Queries written as SQL text, report levels, rejects and exact binomials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.catalog import choice_queries, math_queries, oracle
from gradeframe.catalog.math_queries import _JUDGED, _MODEL_SCORES, _ROW, rounded
from gradeframe.catalog.registry import query
from gradeframe.catalog.rollouts import choice_rollouts, math_rollouts
from gradeframe.functions import passk, sql
from gradeframe.operators import scoring
from gradeframe.plans.math_eval import score_samples
from gradeframe.sources import jsonl
from gradeframe.sources.tables import spread, table


def _view(samples: DataFrame, name: str) -> SparkSession:
    """The session, with the library's functions and the samples under a name."""
    sql.register(samples.sparkSession)
    samples.createOrReplaceTempView(name)
    return samples.sparkSession


@query(f"SELECT {_ROW}, answer_text, gold, is_correct FROM {_JUDGED}")
def sql_is_equiv(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction and verdict, called from SQL."""
    return _view(math_rollouts(spark, folder), "gradeframe_math").sql(f"""
        SELECT {_ROW}, answer_text, gold, gradeframe_is_equiv(answer_text, gold) AS is_correct
        FROM (SELECT *, gradeframe_extract_answer(output) AS answer_text FROM gradeframe_math)""")


@query(f"""SELECT benchmark, k, round(avg({oracle.pass_at_k('n', 'c', 'k')}), 6) AS pass_at_k
  FROM (SELECT *, unnest([1, 2, 3, 4]::BIGINT[]) AS k FROM {math_queries._SCORES})
  GROUP BY benchmark, k""")
def sql_pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """From raw outputs to Pass@k of benchmarks, all of it SQL text."""
    return _view(math_rollouts(spark, folder), "gradeframe_math").sql("""
        WITH judged AS (
          SELECT benchmark, example_id, gradeframe_is_equiv(gradeframe_extract_answer(output), gold) AS is_correct
          FROM gradeframe_math),
        scores AS (
          SELECT benchmark, example_id, count(*) AS n, count_if(is_correct) AS c FROM judged GROUP BY ALL),
        histogram AS (SELECT benchmark, n, c, count(*) AS examples FROM scores GROUP BY ALL),
        curve AS (
          SELECT benchmark, k, examples, gradeframe_pass_at_k(n, c, k) AS value
          FROM histogram LATERAL VIEW explode(array(1L, 2L, 3L, 4L)) AS k)
        SELECT benchmark, k, round(sum(value * examples) / sum(examples), 6) AS pass_at_k
        FROM curve GROUP BY benchmark, k""")


@query(f"SELECT {_ROW}, choice FROM {choice_queries._CHOSEN}")
def sql_choice_letter(spark: SparkSession, folder: str) -> DataFrame:
    """Choice letters, called from SQL."""
    return _view(choice_rollouts(spark, folder), "gradeframe_choice").sql(
        f"SELECT {_ROW}, gradeframe_choice_letter(output, labels) AS choice FROM gradeframe_choice")


@query(f"""SELECT CASE WHEN grouping(benchmark) = 0 THEN 'model,benchmark' WHEN grouping(model) = 0 THEN 'model'
      ELSE 'all' END AS level, model, benchmark, k, count(*) AS total_examples,
    count(*) FILTER (WHERE c > 0) AS correct_at_least_once,
    round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS accuracy_any,
    round(avg({oracle.pass_at_k('n', 'c', 'k')}), 6) AS pass_at_k
  FROM (SELECT *, unnest([1, 2, 4]::BIGINT[]) AS k FROM {_MODEL_SCORES})
  GROUP BY GROUPING SETS ((model, benchmark, k), (model, k), (k))""")
def report_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Per model and benchmark, per model, and over all, from one histogram."""
    scores = score_samples(math_rollouts(spark, folder), ["model", "benchmark", "example_id"])
    return scoring.report_levels(scores, ks=[1, 2, 4]).withColumns(rounded("accuracy_any", "pass_at_k"))


_RAW_LINE = """CASE o_orderkey % 8
  WHEN 0 THEN '{"question":"q","answer":"' || g || '","outputs":["' || g || '",null]}'
  WHEN 1 THEN '{"question":"q","answer":"' || g || '","outputs":["' || g
  WHEN 2 THEN '{"question":"q","outputs":[]}'
  WHEN 3 THEN '[' || g || ',2]'
  WHEN 4 THEN 'no json: ' || g
  WHEN 5 THEN '{"question":null,"answer":5}'
  WHEN 6 THEN '  {"outputs":["a"],"answer":' || g || ',"question":"' || g || '?"} '
  ELSE ' 　 ' END"""
_RAW_PARTS = "CAST(o_custkey % 4 AS STRING) AS g"


@query(f"""SELECT o_orderkey, fields ->> 'question' AS question, fields ->> 'answer' AS answer,
    json_array_length(fields, '$.outputs')::INTEGER AS outputs, CASE WHEN reason <> '' THEN reason END AS reason,
    CASE WHEN reason <> '' THEN value END AS line
  FROM (SELECT *, CASE WHEN fields IS NULL THEN 'malformed' ELSE concat(CASE WHEN len(lacks) > 0 THEN 'missing field: '
          ELSE '' END, array_to_string(lacks, ', ')) END AS reason
    FROM (SELECT *, list_filter(['question', 'answer', 'outputs'], lambda f: (fields ->> f) IS NULL) AS lacks
      FROM (SELECT *, CASE WHEN json_valid(value) THEN CASE WHEN json_type(value) = 'OBJECT' THEN value::JSON END END AS fields
        FROM (SELECT o_orderkey, {_RAW_LINE} AS value FROM (SELECT o_orderkey, {_RAW_PARTS} FROM orders))
        WHERE o_orderkey % 8 <> 7)))""")
def dataset_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Good records and rejects of lines of which some are broken, from one pass."""
    lines = (spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
             .selectExpr("o_orderkey", _RAW_PARTS).select("o_orderkey", F.expr(_RAW_LINE).alias("value")))
    records = jsonl.checked(lines, jsonl.RAW_SCHEMA, ["question", "answer", "outputs"])
    return records.select(
        "o_orderkey", "question", "answer", F.when(F.col("outputs").isNotNull(), F.size("outputs")).alias("outputs"),
        "rejected.reason", "rejected.line")


@query("""SELECT p_partkey, list_reduce(list_prepend(1::HUGEINT, range(1, k + 1)::HUGEINT[]),
      lambda acc, i: acc * (n - k + i) // i)::VARCHAR AS ways
  FROM (SELECT p_partkey, p_size + 10 AS n, (p_size + 10) // 2 AS k FROM part)""")
def exact_binomial(spark: SparkSession, folder: str) -> DataFrame:
    """Middle binomials of up to 60, every digit."""
    sizes = table(spark, folder, "part").selectExpr("p_partkey", "p_size + 10 AS n", "(p_size + 10) DIV 2 AS k")
    return sizes.select("p_partkey", passk.exact_binomial("n", "k").cast("string").alias("ways"))
