"""Readers, writers and discovery on files."""

import json

import pytest
from pyspark.sql import functions as F

from gradeframe.plans import math_eval
from gradeframe.sources import discovery, jsonl, logs, sinks
from helpers import rows


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
                              for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_math_benchmark(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", [{"question": "一?", "answer": 42}, {"question": "q", "answer": "1.0"}])
    df = jsonl.read_math_benchmark(spark, "aime24", {"aime24": path})
    assert [(r["question"], r["answer"], r["benchmark"]) for r in df.orderBy("example_id").collect()] == [
        ("一?", "42", "aime24"), ("q", "1.0", "aime24")]
    with pytest.raises(ValueError, match="unknown benchmark"):
        jsonl.read_math_benchmark(spark, "csqa_dev")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.read_math_benchmark(spark, "aime24", {"aime24": str(tmp_path / "none")})


def test_missing_and_malformed_rows_fail(spark, tmp_path):
    lacking = write(tmp_path / "b.jsonl", [{"question": "q"}])
    with pytest.raises(Exception, match="missing field: answer"):
        jsonl.read_math_benchmark(spark, "b", {"b": lacking}).collect()
    broken = write(tmp_path / "c.jsonl", ['{"question": "q", '])
    with pytest.raises(Exception):
        jsonl.read_math_benchmark(spark, "c", {"c": broken}).collect()


def choice(**changes):
    item = {"id": "1", "question": "q", "question_concept": "c", "answerKey": "A",
            "choices": {"label": ["A", "B"], "text": ["x", "y"]}, **changes}
    return {k: v for k, v in item.items() if v != "-"}


def test_choice_benchmark(spark, tmp_path):
    good = write(tmp_path / "d.jsonl", [choice(), choice(id="2", answerKey=None)])
    with pytest.raises(Exception, match="missing field: answerKey"):
        jsonl.read_choice_benchmark(spark, "csqa", {"csqa": good}).collect()
    kept = jsonl.read_choice_benchmark(spark, "csqa", {"csqa": good}, allow_null_key=True)
    assert kept.count() == 2
    bad = write(tmp_path / "e.jsonl", [choice(), choice(question="-"), choice(choices="-", answerKey="-")])
    items = spark.read.schema(jsonl.CHOICE_SCHEMA).json(bad)
    assert rows(jsonl.rejects(items, ["question", "choices", "answerKey"]).select("missing")) == [
        (["choices", "answerKey"],), (["question"],)]


def test_tolerant_answers(spark, tmp_path):
    path = write(tmp_path / "f.jsonl", [
        {"answer": 42, "predicted_answers": ["42", 42, 1.0, True, None]}, "   ",
        {"predicted_answers": "7"}, {"answer": "1"}, {"answer": "1", "predicted_answers": None},
        {"answer": None, "predicted_answers": []}, '{"answer": "[x", "predicted_answers": "[y"}',
        '{"answer": 1e3, "predicted_answers": [1e3, {"a": 1}]}'])
    got = [(r["answer"], r["predicted_answers"])
           for r in jsonl.read_answers(spark, path).orderBy("example_id").collect()]
    assert got == [
        ("42", ["42", "42", "1.0", "true", None]), ("", ["7"]), ("1", []), ("1", [None]), (None, []),
        ("[x", ["[y"]), ("1000.0", ["1000.0", '{"a":1}'])]


def test_malformed_answer_line_fails(spark, tmp_path):
    path = write(tmp_path / "g.jsonl", ['{"answer": '])
    with pytest.raises(Exception):
        jsonl.read_answers(spark, path).collect()


def test_raw_to_answers_to_results(spark, tmp_path):
    # Records and the figures that they must give.
    raw = write(tmp_path / "raw.jsonl", [
        {"question": "What is 2+2?", "answer": "4", "outputs": [r"The answer is \boxed{4}", "Answer: 4"]},
        {"question": "ünï", "answer": r"\frac{14}{3}", "outputs": [r"The result is \frac{14}{3}", "é"]},
        {"question": "none", "answer": "1", "outputs": []}])
    generations = jsonl.read_raw_generations(spark, raw).withColumn("benchmark", F.lit("test"))
    from gradeframe.operators import extraction, layout
    answered = extraction.extract_answers(layout.explode_samples(generations))
    out = str(tmp_path / "answers")
    sinks.write_answers(answered, out)
    back = spark.read.json(out)
    assert "part" not in back.columns
    assert rows(back.select("question", "predicted_answers", "benchmark")) == [
        ("What is 2+2?", ["4", "4"], "test"), ("ünï", [r"\frac{14}{3}", "é"], "test")]
    arrays = str(tmp_path / "arrays")
    sinks.write_answer_arrays(extraction.extract_answer_arrays(generations), arrays)
    assert rows(spark.read.json(arrays).select("question", "predicted_answers").where(
        "size(predicted_answers) > 0")) == rows(back.select("question", "predicted_answers"))
    quick = jsonl.read_answers(spark, arrays + "/benchmark=test", arrays_only=True)
    assert math_eval.score_answers(quick.withColumn("benchmark", F.lit("test"))).first()[
        "total_examples"] == 3
    summary = math_eval.score_raw(generations)
    row = summary.first()
    assert (row["total_examples"], row["correct_at_least_once"]) == (3, 2)
    assert row["pass_at_k"] == pytest.approx({"pass@1": 0.75, "pass@2": 1.0})
    answers = jsonl.read_answers(spark, out + "/benchmark=test").withColumn("benchmark", F.lit("test"))
    again = math_eval.score_answers(answers).first()
    assert again["pass_at_k"] == row["pass_at_k"] and again["total_examples"] == 2
    sinks.write_results(summary, str(tmp_path / "result"))
    sinks.write_summary(summary, str(tmp_path / "summary"))
    text = next((tmp_path / "summary").glob("part-*.json")).read_text()
    assert '"pass_at_k":{"pass@1":0.75,"pass@2":1.0}' in text
    sinks.write_summary(summary.where("false"), str(tmp_path / "empty"))
    assert spark.read.schema(summary.schema).json(str(tmp_path / "empty")).count() == 0


def test_runs_are_partitions(spark, tmp_path):
    out = str(tmp_path / "runs")
    first = spark.createDataFrame([("m1", "251201000000", 1), ("m2", "251201000000", 2)],
                                  "model string, run_ts string, v int")
    sinks.append_generations(first, out)
    sinks.append_generations(first.withColumn("v", F.col("v") + 10), out)
    read = spark.read.schema("v int, model string, run_ts string").parquet
    assert rows(read(out).select("model", "v")) == [("m1", 1), ("m1", 11), ("m2", 12), ("m2", 2)]
    sinks.write_run(first.where("model = 'm1'"), out)
    assert rows(read(out).select("model", "run_ts", "v")) == [
        ("m1", "251201000000", 1), ("m2", "251201000000", 12), ("m2", "251201000000", 2)]


def test_choice_results_keep_nulls(spark, tmp_path):
    out = str(tmp_path / "choice")
    results = spark.createDataFrame([("csqa", "1", ["A", None])],
                                    "benchmark string, id string, predicted_answers array<string>")
    sinks.write_choice_results(results, out)
    assert jsonl.read_choice_results(spark, out + "/benchmark=csqa").first()["predicted_answers"] == ["A", None]


def test_run_config_log(spark, tmp_path):
    from gradeframe.operators import prompting
    prompts = spark.createDataFrame([("b", i, f"p{i}") for i in (3, 1, 2)],
                                    "benchmark string, example_id long, prompt string")
    config = prompting.run_config(prompts, ["benchmark"], k=4)
    sinks.append_run_config(config, str(tmp_path / "log"))
    sinks.append_run_config(config, str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log"))
    assert rows(logged.select("first_prompt", "examples", "generations")) == [("p1", 3, 12)] * 2


def test_run_log(spark):
    from datetime import datetime
    items = spark.createDataFrame([(i, f"q{i}", b) for b in ("aime24", "math500") for i in (2, 1)],
                                  "example_id long, question string, benchmark string")
    table = math_eval.math_prompts(items, "think", k=32).withColumn("prompt", F.col("messages")[0]["content"])
    stamp = sinks.run_timestamp(datetime(2025, 10, 25, 12, 14, 5))
    log = math_eval.run_log(table, "/models/M-8B/", stamp, 32)
    assert {r["first_messages"][0]["content"] for r in log.collect()} == {"q1 /think"}
    assert rows(log.select("model", "run_ts", "benchmark", "max_tokens", "first_prompt", "generations")) == [
        ("M-8B", "251025121405", "aime24", 38912, "q1 /think", 64),
        ("M-8B", "251025121405", "math500", 32768, "q1 /think", 64)]


def test_benchmark_discovery(spark, tmp_path):
    out = str(tmp_path / "data")
    spark.createDataFrame([("aime24", 1), ("other", 2)], "benchmark string, v int").write.partitionBy(
        "benchmark").parquet(out)
    df = spark.read.parquet(out)
    chosen = discovery.only_benchmarks(df)
    assert rows(chosen) == [(1, "aime24")]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [benchmark" in plan
    assert rows(discovery.absent(df, list(jsonl.MATH_BENCHMARKS))) == [
        ("aime25",), ("math500",), ("olympiadbench",)]


def test_checkpoints_in_natural_order(spark):
    steps = spark.createDataFrame([("s", f"step{i}") for i in (10, 2, 100)], "strategy string, step_name string")
    ordered = steps.withColumn("step", discovery.checkpoint_step("step_name")).orderBy("step")
    assert [r["step_name"] for r in ordered.collect()] == ["step2", "step10", "step100"]
    found = spark.createDataFrame([("s_step2",), ("x_step10",)], "checkpoint string")
    assert rows(discovery.skipped_checkpoints(steps, found).select("step_name")) == [
        ("step10",), ("step100",)]


def test_log_tail(spark, tmp_path):
    write(tmp_path / "m1.log", [f"line {i} pass@1: {i}" if i % 2 else f"noise {i}" for i in range(40)])
    write(tmp_path / "m2.log", ["accuracy_any 3", "Pass@1 4", "pass@2 5"])
    lines = logs.read_log_lines(spark, str(tmp_path / "*.log"))
    tail = logs.log_tail(lines).orderBy("log", "line_no").collect()
    assert [r["line"] for r in tail if r["log_name"] == "m1.log"] == [
        f"line {i} pass@1: {i}" for i in range(21, 40, 2)]
    assert [r["line"] for r in tail if r["log_name"] == "m2.log"] == ["accuracy_any 3", "Pass@1 4"]


def test_logs_of_the_same_name_stay_apart(spark, tmp_path):
    for part in "ab":
        (tmp_path / part).mkdir()
        write(tmp_path / part / "eval.log", [f"pass@1 {part}{i}" for i in range(8)])
    tail = logs.log_tail(logs.read_log_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")]))
    assert rows(tail.groupBy("log").count().select("count")) == [(8,), (8,)]


def test_names_in_natural_order(spark):
    names = ["run10_step2", "run2_step5", "run2_step10", "ckpt-100-hf7", "ckpt-20-hf7", "run02_step5"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in df.orderBy(discovery.natural_order("name")).collect()] == [
        "ckpt-20-hf7", "ckpt-100-hf7", "run02_step5", "run2_step5", "run2_step10", "run10_step2"]


def test_lines_of_unicode_blanks_are_skipped(spark, tmp_path):
    path = write(tmp_path / "u.jsonl", [{"answer": "1", "predicted_answers": ["1"]}, "\u00a0\u3000"])
    assert jsonl.read_answers(spark, path).count() == 1
    raw = write(tmp_path / "v.jsonl", ["\u3000", {"question": "q", "answer": "1", "outputs": ["1"]}])
    assert jsonl.read_raw_generations(spark, raw).count() == 1


def test_five_thousand_samples_are_one_example(spark, tmp_path):
    samples = spark.range(5000).select(
        F.lit("b").alias("benchmark"), F.lit("x").alias("example_id"), F.lit("q").alias("question"),
        F.lit("7").alias("answer"), F.col("id").alias("sample_idx"),
        F.when(F.col("id") < 10, "7").otherwise("8").alias("answer_text"))
    sinks.write_answers(samples, str(tmp_path / "big"))
    back = jsonl.read_answers(spark, str(tmp_path / "big/benchmark=b")).withColumn("benchmark", F.lit("b"))
    row = math_eval.score_answers(back, ks=[1]).first()
    assert row["total_examples"] == 1 and row["pass_at_k"]["pass@1"] == pytest.approx(0.002)
    assert set(back.columns) == {"answer", "predicted_answers", "example_id", "benchmark"}


def test_a_run_folder_is_scored_in_one_job(spark, tmp_path):
    def record(i, right):
        return {"question": f"q{i}", "answer": "4", "outputs": [r"\boxed{4}" if right else r"\boxed{5}", "no 5"]}
    write(tmp_path / "aime24_raw.jsonl", [record(i, i % 2) for i in range(40)])
    write(tmp_path / "math500_raw.jsonl", [record(i, False) for i in range(3)] + ["  "])
    write(tmp_path / "other_raw.jsonl", [record(1, True)])
    write(tmp_path / "aime25.jsonl", [{"answer": "1", "predicted_answers": ["1"]}])
    raw = jsonl.read_raw_folder(spark, str(tmp_path))
    got = math_eval.score_raw(raw.withColumn("model", F.lit("m")), ["model", "benchmark"])
    assert rows(got.select("benchmark", "total_examples", "correct_at_least_once")) == [
        ("aime24", 40, 20), ("math500", 3, 0)]
    whole = math_eval.score_raw(raw.withColumn("model", F.lit("m")), ["model"]).first()
    assert (whole["total_examples"], whole["correct_at_least_once"]) == (43, 20)
    assert rows(discovery.absent(raw, list(jsonl.MATH_BENCHMARKS))) == [("aime25",), ("olympiadbench",)]
    answers = jsonl.read_answer_folder(spark, str(tmp_path))
    assert rows(answers.select("benchmark")) == [("aime25",)]
    assert math_eval.score_answers(answers).first()["total_examples"] == 1


def test_example_ids_do_not_depend_on_splits(spark, tmp_path):
    path = write(tmp_path / "s.jsonl", [{"question": f"q{i}", "answer": "1", "outputs": []} for i in range(500)])
    ids = rows(jsonl.read_raw_generations(spark, path).select("example_id", "question"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        split = jsonl.read_raw_generations(spark, path)
        assert split.rdd.getNumPartitions() > 1
        assert rows(split.select("example_id", "question")) == ids
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [q for _, q in ids] == [f"q{i}" for i in range(500)]


def test_a_batch_written_again_is_not_doubled(spark, tmp_path):
    out = str(tmp_path / "batches")
    first = spark.createDataFrame([("m1", "251201000000", 1)], "model string, run_ts string, v int")
    for _ in range(2):
        sinks.append_generations(first, out, batch="b1")
    sinks.append_generations(first.withColumn("v", F.lit(2)), out, batch="b2")
    assert rows(spark.read.parquet(out).select("v", "batch")) == [(1, "b1"), (2, "b2")]
