"""Queries over math rollouts: extraction, equivalence, Pass@k, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.catalog import oracle
from gradeframe.catalog.registry import query
from gradeframe.catalog.rollouts import MATH_SQL, SPELLING_SQL, answer_spellings, math_rollouts
from gradeframe.functions import equivalence, extract, passk
from gradeframe.operators import curves, extraction, layout, scoring
from gradeframe.plans.math_eval import example_curves, judged_samples, score_samples
from gradeframe.sources.discovery import only_benchmarks
from gradeframe.sources.tables import spread, table

ROW = ("example_id", "line_no", "part_key", "supp_key")
_ROW = ", ".join(ROW)
_ANSWERED = f"(SELECT *, {oracle.answer('output')} AS answer_text FROM {MATH_SQL})"
_JUDGED = oracle.judged(_ANSWERED, "answer_text", "gold")


def _scores_sql(*keys: str, source: str = _JUDGED) -> str:
    listed = ", ".join(keys)
    return f"""(SELECT {listed}, count(*) AS n, count(*) FILTER (WHERE is_correct) AS c
      FROM {source} GROUP BY {listed})"""


_SCORES = _scores_sql("benchmark", "example_id")
_MODEL_SCORES = _scores_sql("model", "benchmark", "example_id")


def rounded(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


def _rows(spark: SparkSession, folder: str, answer: Column) -> DataFrame:
    return math_rollouts(spark, folder).select(*ROW, answer.alias("answer_text"))


def _rows_sql(expression: str) -> str:
    return f"SELECT {_ROW}, {expression} AS answer_text FROM {MATH_SQL}"


@query(_rows_sql(oracle.boxed("output")))
def extract_boxed(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, extract.boxed_answer("output"))


@query(_rows_sql(oracle.fraction("output")))
def extract_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, extract.latex_fraction("output"))


@query(_rows_sql(oracle.marker("output")))
def extract_marker(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, extract.marked_answer("output"))


@query(_rows_sql(oracle.number("output")))
def extract_number(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, extract.last_number("output"))


@query(_rows_sql(oracle.last_line("output")))
def extract_last_line(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder, extract.last_line("output"))


@query(f"""SELECT {_ROW}, {oracle.answer('output')} AS answer_text,
  {oracle.strategy('output')} AS strategy FROM {MATH_SQL}""")
def extract_answer(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract_answers(math_rollouts(spark, folder), strategy="strategy")
    return found.select(*ROW, "answer_text", "strategy")


@query(f"""SELECT doc_id, {oracle.answer('text')} AS answer_text,
  {oracle.strategy('text')} AS strategy FROM documents""")
def extract_answer_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    found = extraction.extract_answers(documents, "text", strategy="strategy")
    return found.select("doc_id", "answer_text", "strategy")


@query(f"""SELECT benchmark, strategy, count(*) AS samples
  FROM (SELECT benchmark, {oracle.strategy('output')} AS strategy FROM {MATH_SQL})
  GROUP BY benchmark, strategy""")
def strategy_histogram(spark: SparkSession, folder: str) -> DataFrame:
    found = extraction.extract_answers(math_rollouts(spark, folder), strategy="strategy")
    return extraction.strategy_histogram(found, "benchmark")


@query(f"""SELECT benchmark, example_id,
  string_agg(coalesce(answer_text, '~'), '|' ORDER BY sample_idx) AS predicted
  FROM {_ANSWERED} GROUP BY benchmark, example_id""")
def predicted_answer_lists(spark: SparkSession, folder: str) -> DataFrame:
    answered = extraction.extract_answers(math_rollouts(spark, folder, positions=True))
    lists = layout.collect_samples(answered, ["benchmark", "example_id"], "answer_text",
                                   "predicted_answers")
    return lists.select("benchmark", "example_id",
                        F.array_join("predicted_answers", "|", "~").alias("predicted"))


@query(f"SELECT {_ROW}, answer_text, {oracle.normal('answer_text')} AS normal_form "
       f"FROM {SPELLING_SQL}")
def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    return answer_spellings(spark, folder).select(
        *ROW, "answer_text", equivalence.normalize_answer("answer_text").alias("normal_form"))


@query(f"""SELECT {_ROW}, normal_form, round({oracle.parsed('normal_form')}, 6) AS number
  FROM (SELECT *, {oracle.normal('answer_text')} AS normal_form FROM {SPELLING_SQL})""")
def parse_number(spark: SparkSession, folder: str) -> DataFrame:
    normal = answer_spellings(spark, folder).withColumn(
        "normal_form", equivalence.normalize_answer("answer_text"))
    return scoring.parse_numbers(normal, "normal_form").select(
        *ROW, "normal_form", F.round("number", 6).alias("number"))


@query(f"SELECT {_ROW}, answer_text, gold, is_correct FROM {_JUDGED}")
def is_equiv(spark: SparkSession, folder: str) -> DataFrame:
    return judged_samples(math_rollouts(spark, folder)).select(
        *ROW, "answer_text", "gold", "is_correct")


@query(f"SELECT {_ROW}, answer_text, gold, is_correct "
       f"FROM {oracle.judged(SPELLING_SQL, 'answer_text', 'gold')}")
def is_equiv_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.judge(answer_spellings(spark, folder)).select(
        *ROW, "answer_text", "gold", "is_correct")


@query(f"SELECT benchmark, example_id, n, c FROM {_SCORES}")
def example_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_samples(math_rollouts(spark, folder))


@query(f"""SELECT benchmark, example_id, n, c, k, round({oracle.pass_at_k('n', 'c', 'k')}, 6)
  AS pass_at_k FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM {_SCORES})""")
def passk_per_example(spark: SparkSession, folder: str) -> DataFrame:
    return example_curves(math_rollouts(spark, folder)).withColumns(rounded("pass_at_k"))


@query(f"""SELECT benchmark, k, round(avg({oracle.pass_at_k('n', 'c', 'k')}), 6) AS pass_at_k
  FROM (SELECT *, unnest([1, 2, 3, 4]::BIGINT[]) AS k FROM {_SCORES})
  GROUP BY benchmark, k""")
def passk_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    return scoring.pass_at_k_by(scores, ks=[1, 2, 3, 4], on_short="clamp").withColumns(rounded("pass_at_k"))


@query(f"""SELECT benchmark, k, round(avg({oracle.pass_at_k('n', 'c', 'k')}), 6) AS pass_at_k
  FROM (SELECT s.*, unnest(range(1, f.first_n + 1)) AS k FROM {_SCORES} s
    JOIN (SELECT benchmark, arg_min(n, example_id) AS first_n FROM {_SCORES}
      GROUP BY benchmark) f USING (benchmark))
  GROUP BY benchmark, k""")
def passk_first_example_ks(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    return scoring.pass_at_k_by(scores, on_short="clamp").withColumns(rounded("pass_at_k"))


@query(f"""SELECT benchmark, count(*) AS total_examples,
  count(*) FILTER (WHERE c > 0) AS correct_at_least_once,
  round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS accuracy_any
  FROM {_SCORES} GROUP BY benchmark""")
def accuracy_any(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    return scoring.accuracy_any(scores).withColumns(rounded("accuracy_any"))


def _mean_sql(k: int, scores: str = _SCORES) -> str:
    return (f"(SELECT benchmark, round(avg({oracle.pass_at_k('n', 'c', str(k))}), 6) AS pass_{k} "
            f"FROM {scores} GROUP BY benchmark)")


_SUMMARY = f"""(SELECT benchmark, count(*) AS total_examples,
    count(*) FILTER (WHERE c > 0) AS correct_at_least_once,
    count(*) FILTER (WHERE c > 0) / count(*) AS accuracy
  FROM {_SCORES} GROUP BY benchmark)"""


@query(f"""SELECT benchmark, total_examples, correct_at_least_once,
    round(accuracy, 6) AS accuracy_any, pass_1, pass_2, pass_4
  FROM {_SUMMARY} JOIN {_mean_sql(1)} USING (benchmark) JOIN {_mean_sql(2)} USING (benchmark)
    JOIN {_mean_sql(4)} USING (benchmark)""")
def benchmark_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    summary = scoring.benchmark_summary(scores, ks=[1, 2, 4], on_short="clamp")
    flat = {f"pass_{k}": F.round(F.try_element_at("pass_at_k", F.lit(f"pass@{k}")), 6)
            for k in (1, 2, 4)}
    return summary.withColumns({**rounded("accuracy_any"), **flat}).drop("pass_at_k")


@query(f"""SELECT benchmark, round(pass_1, 6) AS pass_at_1, round(accuracy, 6) AS accuracy_any,
    printf('%.2f%%', accuracy * 100) AS accuracy_shown, printf('%.4f', pass_1) AS pass_at_1_shown
  FROM {_SUMMARY} JOIN (SELECT benchmark, avg(c / n) AS pass_1 FROM {_SCORES} GROUP BY benchmark)
    USING (benchmark)""")
def quick_results(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    quick = scoring.quick_results(scoring.benchmark_summary(scores, ks=[1]))
    shown = {"accuracy_shown": passk.percent_text("accuracy_any"),
             "pass_at_1_shown": passk.score_text("pass_at_1")}
    return quick.withColumns(shown).withColumns(rounded("pass_at_1", "accuracy_any"))


_ORDER_BENCHMARK = """CASE o_orderkey % 3 WHEN 0 THEN 'bench_a' WHEN 1 THEN 'bench_b'
  ELSE 'bench_c' END"""


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        f"{_ORDER_BENCHMARK} AS benchmark", "o_orderkey AS example_id",
        "CAST(o_orderkey % 4 AS STRING) AS gold")


_WITH_EMPTY = f"""(SELECT q.benchmark, q.example_id, coalesce(n, 0) AS n, coalesce(c, 0) AS c
  FROM (SELECT {_ORDER_BENCHMARK} AS benchmark, o_orderkey AS example_id FROM orders) q
  LEFT JOIN {_SCORES} s USING (benchmark, example_id))"""


@query(f"""SELECT benchmark, count(*) AS total_examples,
    count(*) FILTER (WHERE c > 0) AS correct_at_least_once,
    round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS accuracy_any,
    round(avg({oracle.pass_at_k('n', 'c', '1')}) FILTER (WHERE n > 0), 6) AS pass_at_1
  FROM {_WITH_EMPTY} GROUP BY benchmark""")
def passk_empty_examples(spark: SparkSession, folder: str) -> DataFrame:
    answered = extraction.extract_answers(math_rollouts(spark, folder).drop("gold"))
    scores = scoring.score_answers(answered, _questions(spark, folder), ["benchmark", "example_id"])
    first = F.try_element_at("pass_at_k", F.lit("pass@1"))
    return (scoring.benchmark_summary(scores, ks=[1]).withColumn("pass_at_1", first)
            .drop("pass_at_k").withColumns(rounded("accuracy_any", "pass_at_1")))


_BINOMIAL = ("CASE WHEN 2 > c THEN 0.0 ELSE "
             "list_aggregate(list_transform(range(c - 1, c + 1), lambda i: i::DOUBLE), 'product') / 2 END")


@query(f"""SELECT n, c, count(*) AS examples, {_BINOMIAL} AS correct_pairs
  FROM {_SCORES} GROUP BY n, c""")
def correct_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder))
    return scoring.score_histogram(scores, []).withColumn(
        "correct_pairs", passk.binomial("c", 2))


@query(f"""SELECT benchmark, count(*) AS samples FROM {MATH_SQL}
  WHERE benchmark IN ('bench_a', 'bench_c') GROUP BY benchmark""")
def benchmark_selection(spark: SparkSession, folder: str) -> DataFrame:
    chosen = only_benchmarks(math_rollouts(spark, folder), ["bench_a", "bench_c"])
    return chosen.groupBy("benchmark").agg(F.count(F.lit(1)).alias("samples"))


_MODEL_CURVE = f"""(SELECT model, benchmark, k, avg({oracle.pass_at_k('n', 'c', 'k')}) AS pass_at_k
  FROM (SELECT *, unnest([1, 2, 3, 4]::BIGINT[]) AS k FROM {_MODEL_SCORES})
  GROUP BY model, benchmark, k)"""


def _model_curve(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder), ["model", "benchmark", "example_id"])
    return scoring.pass_at_k_by(scores, ["model", "benchmark"], [1, 2, 3, 4], on_short="clamp")


@query(f"SELECT model, benchmark, k, round(pass_at_k, 6) AS pass_at_k FROM {_MODEL_CURVE}")
def model_passk_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _model_curve(spark, folder).withColumns(rounded("pass_at_k"))


@query(f"""SELECT benchmark, min(k) FILTER (WHERE s.pass_at_k > l.pass_at_k) AS crossover_k,
    count(*) FILTER (WHERE s.pass_at_k > l.pass_at_k) AS ks_ahead, count(*) AS ks_compared,
    'm0' AS small_model, 'm1' AS large_model
  FROM (SELECT * FROM {_MODEL_CURVE} WHERE model = 'm0') s
  JOIN (SELECT * FROM {_MODEL_CURVE} WHERE model = 'm1') l USING (benchmark, k)
  GROUP BY benchmark""")
def crossover_k(spark: SparkSession, folder: str) -> DataFrame:
    return curves.crossover(_model_curve(spark, folder), "m0", "m1")


_DELTAS = f"""(SELECT a.model, benchmark, k, a.pass_at_k, b.pass_at_k AS baseline_value,
    (a.pass_at_k - b.pass_at_k) * 100 AS delta
  FROM {_MODEL_CURVE} a JOIN (SELECT * FROM {_MODEL_CURVE} WHERE model = 'm0') b
    USING (benchmark, k) WHERE a.model <> 'm0')"""


def _deltas(spark: SparkSession, folder: str) -> DataFrame:
    return curves.delta_to_baseline(_model_curve(spark, folder), "m0", ["benchmark", "k"],
                                    "model", "pass_at_k", scale=100.0)


@query(f"""SELECT model, benchmark, k, round(pass_at_k, 6) AS pass_at_k,
  round(baseline_value, 6) AS baseline_value, round(delta, 6) AS delta FROM {_DELTAS}""")
def delta_vs_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return _deltas(spark, folder).withColumns(rounded("pass_at_k", "baseline_value", "delta"))


@query(f"""SELECT model, round(avg(delta), 6) AS mean_delta, count(*) AS compared
  FROM {_DELTAS} GROUP BY model""")
def mean_delta(spark: SparkSession, folder: str) -> DataFrame:
    return curves.mean_delta(_deltas(spark, folder), ["model"]).withColumns(rounded("mean_delta"))


_STEP_CURVE = f"""(SELECT benchmark, step, avg(c / n) AS pass_at_1
  FROM {_scores_sql('step', 'benchmark', 'example_id')} GROUP BY benchmark, step)"""


@query(f"""SELECT benchmark, step, round(pass_at_1, 6) AS pass_at_1,
  round(pass_at_1 - lag(pass_at_1) OVER (PARTITION BY benchmark ORDER BY step), 6) AS change
  FROM {_STEP_CURVE}""")
def metric_by_step(spark: SparkSession, folder: str) -> DataFrame:
    scores = score_samples(math_rollouts(spark, folder), ["step", "benchmark", "example_id"])
    curve = (scoring.pass_at_k_by(scores, ["benchmark", "step"], ks=[1]).drop("k")
             .withColumnRenamed("pass_at_k", "pass_at_1"))
    return curves.step_delta(curve, "pass_at_1", ["benchmark"]).withColumns(
        rounded("pass_at_1", "change"))


_NONE_SQL = f"""(SELECT benchmark, example_id, n, c FROM {_WITH_EMPTY}
  UNION ALL SELECT 'bench_none', c_custkey, 0, 0 FROM customer)"""


@query(f"""SELECT benchmark, count(*) AS total_examples,
    count(*) FILTER (WHERE c > 0) AS correct_at_least_once,
    round(count(*) FILTER (WHERE c > 0) / count(*), 6) AS accuracy_any,
    round(avg({oracle.pass_at_k('n', 'c', '1')}) FILTER (WHERE n > 0), 6) AS pass_at_1
  FROM {_NONE_SQL} GROUP BY benchmark""")
def passk_no_samples(spark: SparkSession, folder: str) -> DataFrame:
    """A benchmark none of whose questions has a sample keeps its counts and has no Pass@k."""
    extra = table(spark, folder, "customer").selectExpr(
        "'bench_none' AS benchmark", "c_custkey AS example_id")
    questions = _questions(spark, folder).select("benchmark", "example_id").unionByName(extra)
    scores = scoring.with_empty_examples(
        score_samples(math_rollouts(spark, folder)), questions, ["benchmark", "example_id"])
    first = F.try_element_at("pass_at_k", F.lit("pass@1"))
    return (scoring.benchmark_summary(scores, ks=[1]).withColumn("pass_at_1", first)
            .drop("pass_at_k").withColumns(rounded("accuracy_any", "pass_at_1")))


@query(f"""SELECT {_ROW}, answer_text, gold, coalesce(p = g OR abs(pn - gn) < 1e-6, false) AS is_correct
  FROM {_JUDGED}""")
def is_equiv_strict(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts without the rule that a gold answer may be contained in the prediction."""
    return judged_samples(math_rollouts(spark, folder), strict=True).select(
        *ROW, "answer_text", "gold", "is_correct")


_NESTED = """chr(92) || 'boxed{1} ' || chr(92) || 'boxed{' || chr(92) || 'sqrt{' || chr(92) || 'frac{' || v
  || '}{{x}{' || chr(92) || 'text{y' || '{z}' || '}}}}' || CASE form % 3 WHEN 0 THEN '}'
  WHEN 1 THEN ' open' ELSE '} and ' || chr(92) || 'boxed{ {{{{' || v || '}}}} }' END"""
_NESTED_PARTS = ("CAST(l_orderkey AS BIGINT) AS example_id", "l_linenumber AS line_no",
                 "CAST(CAST(l_quantity AS INT) % 4 AS STRING) AS v", "CAST(l_partkey % 14 AS INT) AS form")


@query(f"""SELECT example_id, line_no, CASE form % 3 WHEN 1 THEN '1' WHEN 2 THEN '{{{{{{{{' || v || '}}}}}}}}'
    ELSE chr(92) || 'sqrt{{' || chr(92) || 'frac{{' || v || '}}{{{{x}}{{' || chr(92) || 'text{{y{{z}}}}}}}}}}' END AS answer_text
  FROM (SELECT {', '.join(_NESTED_PARTS)} FROM lineitem)""")
def extract_boxed_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes with braces five deep, and boxes that never close."""
    lines = spread(table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_orderkey").selectExpr(*_NESTED_PARTS)
    return lines.select("example_id", "line_no", F.expr(_NESTED).alias("output")).select(
        "example_id", "line_no", extract.boxed_answer("output", balanced=True).alias("answer_text"))
