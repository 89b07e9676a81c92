"""Rollout tables derived from the star schema, in Spark and as SQL text.

The star schema holds no model outputs. Answers of every shape the extraction
rules know are therefore derived from ``lineitem``: an order is an example, its
lines are the samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.operators.skew import with_position
from gradeframe.sources.tables import spread, table

# Text forms of a math rollout; ``v`` is the value it states.
MATH_OUTPUT = """CASE form
  WHEN 0 THEN 'Therefore ' || chr(92) || 'boxed{' || v || '}'
  WHEN 1 THEN chr(92) || 'boxed{9} is first, ' || chr(92) || 'boxed{ ' || v || ' } is final'
  WHEN 2 THEN 'so ' || chr(92) || 'frac{' || v || '}{1} holds. Answer: 9'
  WHEN 3 THEN 'work' || chr(10) || 'Answer: ' || v || '.'
  WHEN 4 THEN 'The FINAL answer is ' || v || '!'
  WHEN 5 THEN 'we count ' || v || ' items'
  WHEN 6 THEN 'step 7' || chr(10) || 'The value is ' || v || '.'
  WHEN 7 THEN 'ratio ' || v || '/1 of 8'
  WHEN 8 THEN '5-' || v || '.0 units'
  WHEN 9 THEN 'roughly 1,00' || v || ' in total'
  WHEN 10 THEN '答案：' || v || '。'
  WHEN 11 THEN chr(92) || 'boxed{' || chr(92) || 'frac{' || v || '}{1}}'
  WHEN 12 THEN 'no digits' || chr(10) || chr(10) || '  last line  ' || chr(10)
  ELSE '' END"""

# Text forms of a choice rollout; ``x`` is the letter it is built from.
CHOICE_OUTPUT = """CASE form
  WHEN 0 THEN 'The answer is (' || x || ').'
  WHEN 1 THEN '  ' || lower(x) || '  '
  WHEN 2 THEN 'hmm' || chr(10) || x || ') yes'
  WHEN 3 THEN 'correct option ' || x
  WHEN 4 THEN 'Choice: ' || x || ' over B'
  WHEN 5 THEN 'Well, ' || x || ' beats C'
  WHEN 6 THEN '[' || x || ']'
  WHEN 7 THEN 'why not go b or ' || lower(x)
  WHEN 8 THEN 'Answer: Because of ' || x
  WHEN 9 THEN 'zz' || lower(x)
  WHEN 10 THEN 'no'
  ELSE 'é' || x || ' ou ' || x || 'é' END"""

# Spellings of one number for the normal form and the parser.
ANSWER_SPELLING = """CASE form
  WHEN 0 THEN '$' || v || '$'
  WHEN 1 THEN '1,00' || v
  WHEN 2 THEN '( (' || v || '.5) )'
  WHEN 3 THEN '== ' || v || '。'
  WHEN 4 THEN v || '0' || chr(92) || '%'
  WHEN 5 THEN chr(92) || 'frac{ ' || v || ' }{4}'
  WHEN 6 THEN chr(92) || 'dfrac{' || v || '}{0}'
  WHEN 7 THEN v || '/0'
  WHEN 8 THEN '-' || v || '.25E-2;'
  WHEN 9 THEN 'X = ' || v || '_0'
  WHEN 10 THEN '1,2,' || v || ',4'
  WHEN 11 THEN v || '_5.0_1'
  WHEN 12 THEN '((((' || v || '))))'
  WHEN 13 THEN '.' || v || 'd'
  WHEN 14 THEN '+Infinity'
  ELSE v || '/' || v || '/2' END"""

LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_shipdate")

# Column name -> expression, valid in both SQL dialects.
MATH_COLUMNS = {
    "benchmark": """CASE l_orderkey % 3 WHEN 0 THEN 'bench_a' WHEN 1 THEN 'bench_b'
      ELSE 'bench_c' END""",
    "example_id": "l_orderkey",
    "line_no": "l_linenumber",
    "part_key": "l_partkey",
    "supp_key": "l_suppkey",
    "model": "'m' || CAST(l_suppkey % 3 AS STRING)",
    "step": "CAST(l_suppkey % 5 AS INT)",
    "gold": "CAST(l_orderkey % 4 AS STRING)",
}
MATH_PARTS = {
    "v": "CAST(CAST(l_quantity AS INT) % 4 AS STRING)",
    "form": "CAST(l_partkey % 14 AS INT)",
}
SPELLING_PARTS = {**MATH_PARTS, "form": "CAST(l_partkey % 16 AS INT)"}
CHOICE_COLUMNS = {
    "benchmark": "CASE l_orderkey % 2 WHEN 0 THEN 'choice_a' ELSE 'choice_b' END",
    "example_id": "l_orderkey",
    "line_no": "l_linenumber",
    "part_key": "l_partkey",
    "supp_key": "l_suppkey",
    "step": "CAST(l_suppkey % 5 AS INT)",
    "answer_key": "substr('ABCDE', CAST(l_orderkey % 5 + 1 AS INT), 1)",
    "labels": "split(CASE WHEN l_orderkey % 7 = 0 THEN 'A,B,C,D' ELSE 'A,B,C,D,E' END, ',')",
}
CHOICE_PARTS = {
    "x": "substr('ABCDE', CAST(CAST(l_quantity AS INT) % 5 + 1 AS INT), 1)",
    "form": "CAST(l_partkey % 12 AS INT)",
}
POSITION_SQL = f"""CAST(row_number() OVER (PARTITION BY l_orderkey
  ORDER BY {', '.join(LINE_ORDER)}) - 1 AS BIGINT)"""


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in columns.items()]


def lines(spark: SparkSession, folder: str, positions: bool = False) -> DataFrame:
    """Order lines, numbered within their order if positions are asked for."""
    df = table(spark, folder, "lineitem").select("l_orderkey", *LINE_ORDER)
    if positions:
        # Numbering distributes the lines itself.
        return with_position(df, ["l_orderkey"], LINE_ORDER, "sample_idx")
    return spread(df, "l_orderkey")


def _derive(df: DataFrame, columns: dict[str, str], parts: dict[str, str], output: str,
            name: str) -> DataFrame:
    kept = [c for c in df.columns if c == "sample_idx"]
    staged = df.selectExpr(*_named(columns), *kept, *_named(parts))
    return staged.select(*columns, *kept, F.expr(output).alias(name))


def math_rollouts(spark: SparkSession, folder: str, positions: bool = False) -> DataFrame:
    return _derive(lines(spark, folder, positions), MATH_COLUMNS, MATH_PARTS, MATH_OUTPUT,
                   "output")


def choice_rollouts(spark: SparkSession, folder: str, positions: bool = False) -> DataFrame:
    return _derive(lines(spark, folder, positions), CHOICE_COLUMNS, CHOICE_PARTS, CHOICE_OUTPUT,
                   "output")


def answer_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return _derive(lines(spark, folder), MATH_COLUMNS, SPELLING_PARTS, ANSWER_SPELLING,
                   "answer_text")


def _sql(columns: dict[str, str], parts: dict[str, str], output: str, name: str) -> str:
    inner = ", ".join(_named({**columns, **parts}))
    return f"""(SELECT *, {output} AS {name} FROM (SELECT {inner}, {POSITION_SQL} AS sample_idx,
      l_quantity, l_extendedprice, l_shipdate FROM lineitem))"""


MATH_SQL = _sql(MATH_COLUMNS, MATH_PARTS, MATH_OUTPUT, "output")
CHOICE_SQL = _sql(CHOICE_COLUMNS, CHOICE_PARTS, CHOICE_OUTPUT, "output")
SPELLING_SQL = _sql(MATH_COLUMNS, SPELLING_PARTS, ANSWER_SPELLING, "answer_text")
