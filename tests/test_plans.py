"""Properties of whole queries: layouts, partitioning, streaming, plan shape."""

import glob
import json
import re

import pytest
from pyspark.sql import functions as F

from gradeframe.catalog import ORACLES, QUERIES
from gradeframe.catalog.rollouts import choice_rollouts, math_rollouts
from gradeframe.operators import extraction, layout, voting
from gradeframe.plans import math_eval
from gradeframe.streaming import scoring as streaming
from helpers import rows

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_entry(spark):
    import __spark_entry__ as contract
    assert contract.entry(spark).count() == 3
    assert QUERIES.keys() <= contract.oracle_sql().keys() <= contract.queries().keys()


def test_scores_do_not_depend_on_partitioning(spark):
    samples = math_rollouts(spark, FOLDER)
    one = math_eval.score_samples(samples.coalesce(1))
    many = math_eval.score_samples(samples.orderBy(F.rand(4)).repartition(8))
    assert rows(one) == rows(many)


def test_votes_do_not_depend_on_partitioning(spark):
    chosen = extraction.extract_choices(choice_rollouts(spark, FOLDER, positions=True), labels="labels")
    by = (["benchmark"], ["example_id"])
    assert rows(voting.choice_accuracy(chosen.coalesce(1), *by)) == rows(
        voting.choice_accuracy(chosen.orderBy(F.rand(4)).repartition(8), *by))


def test_array_layout_equals_long_layout(spark):
    samples = math_rollouts(spark, FOLDER, positions=True)
    arrays = layout.collect_samples(samples, ["benchmark", "example_id", "gold"], "output", "outputs")
    raw = arrays.withColumnRenamed("gold", "answer")
    from gradeframe.operators.scoring import benchmark_summary
    long = benchmark_summary(math_eval.score_samples(samples), ks=[1, 2], on_short="clamp")
    text = F.to_json(F.transform_values("pass_at_k", lambda _, v: F.round(v, 9)))
    names = ["benchmark", "total_examples", "correct_at_least_once", text]
    assert rows(math_eval.score_raw(raw, ks=[1, 2], on_short="clamp").select(*names)) == rows(
        long.select(*names))


def test_scoring_reads_only_its_columns(spark):
    plan = plan_of(QUERIES["example_scores"](spark, FOLDER))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_partkey", "l_quantity"}


def test_scoring_moves_counts_not_texts(spark):
    samples = math_rollouts(spark, FOLDER).repartition(3)
    plan = plan_of(math_eval.score_samples(samples))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.split("Exchange RoundRobin")[0])
    assert len(exchanges) == 1 and plan.index("partial_count") > plan.index("Exchange hash")


def test_no_python_outside_generation(spark):
    for name in QUERIES:
        if name in ("generate_stub",):
            continue
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert not re.search(r"Python|InPandas|CartesianProduct|BroadcastNestedLoop", plan), name


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    records = [{"example_id": i, "gold": str(i % 3), "output": f"Answer: {i % 4}"} for i in range(40)]
    for part in range(2):
        (source / f"{part}.json").write_text("\n".join(json.dumps(r) for r in records[part::2]))
    schema = "example_id long, gold string, output string"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = streaming.read_generation_stream(spark, str(source), schema)
    streaming.append_available(stream, out, state).awaitTermination()
    batch = math_eval.judged_samples(spark.read.schema(schema).json(str(source)))
    assert rows(spark.read.parquet(out)) == rows(batch)
    # A second run only picks up what is new.
    (source / "2.json").write_text(json.dumps({"example_id": 99, "gold": "1", "output": "1"}))
    streaming.append_available(stream, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 41
    assert len(glob.glob(out + "/*.parquet")) >= 3


@pytest.mark.parametrize("name", ["is_equiv", "choice_extract", "extract_answer_documents"])
def test_text_queries_need_no_shuffle_on_large_inputs(spark, monkeypatch, name):
    monkeypatch.setattr("gradeframe.sources.tables._ENOUGH_TASKS", 1)
    assert "Exchange" not in plan_of(QUERIES[name](spark, FOLDER))
