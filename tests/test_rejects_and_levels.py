"""Reject tables, line numbers without a shuffle, partitions, SQL functions, report levels, weighted verdicts."""

import glob
import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gradeframe.catalog import QUERIES
from gradeframe.functions import passk, sql
from gradeframe.operators import extraction, prompting, scoring
from gradeframe.sources import discovery, jsonl, sinks
from gradeframe.streaming import scoring as streaming
from helpers import rows

FOLDER = "/root/testdata/sf0.001"
REQUIRED = ["question", "answer", "outputs"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def broken(tmp_path):
    """Two files with good, malformed, lacking and blank lines."""
    good = json.dumps({"question": "q", "answer": 1.0, "outputs": ["é", None]}, ensure_ascii=False)
    lines = [good, "{\"question\": \"q\"", "", "[1]", json.dumps({"question": "q", "outputs": []}), "　", "null",
             json.dumps({"question": "q", "answer": "a", "outputs": "x"}), "{}", good + " ", " " + good]
    for name in ("aime24_raw.jsonl", "math500_raw.jsonl"):
        (tmp_path / name).write_text("\n".join(lines * 3) + "\n", encoding="utf-8")
    return str(tmp_path), lines * 3


def reason_of(line):
    try:
        record = json.loads(line.strip())
    except ValueError:
        return "malformed"
    if not isinstance(record, dict) or not isinstance(record.get("outputs", []), list):
        return "malformed"
    lacking = [k for k in REQUIRED if record.get(k) is None]
    return "missing field: " + ", ".join(lacking) if lacking else None


@pytest.mark.parametrize("split", ["128m", "100b"])
def test_bad_lines_are_kept_with_their_place(spark, broken, tmp_path, split):
    folder, lines = broken
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = jsonl.read_checked(spark, folder, jsonl.RAW_SCHEMA, REQUIRED, "*_raw.jsonl")
        sinks.write_checked(records, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good, bad = sinks.read_written(spark, str(tmp_path / "out"))
    want = {(name, i): reason_of(line) for name in ("aime24_raw.jsonl", "math500_raw.jsonl")
            for i, line in enumerate(lines) if line.strip()}
    place = lambda r: (r["file_name"], int(r["example_id"].rsplit(":", 1)[1]))
    assert {place(r): r["reason"] for r in bad.collect()} == {k: v for k, v in want.items() if v}
    assert {place(r) for r in good.collect()} == {k for k, v in want.items() if not v}
    for r in bad.collect():
        assert r["line"] == lines[place(r)[1]]
    for r in good.collect():
        assert (r["question"], r["answer"], r["outputs"]) == ("q", "1.0", ["é", None])
    assert "status" in plan_of(bad) and "PartitionFilters: [isnotnull(status" in plan_of(bad)


def test_lines_are_numbered_where_they_are(spark, broken):
    folder, lines = broken
    plan = plan_of(jsonl.read_checked(spark, folder, jsonl.RAW_SCHEMA, REQUIRED, "*_raw.jsonl"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 1


def test_a_file_that_grew_since_it_was_counted_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("{}\n" * 5)
    lines = jsonl.numbered_lines(spark, str(tmp_path))
    assert lines.count() == 5
    assert [r["example_id"][-2:] for r in lines.orderBy("example_id").collect()] == ["00", "01", "02", "03", "04"]
    (tmp_path / "b.jsonl").write_text("{}\n")
    with pytest.raises(Exception, match="split not counted"):
        spark.createDataFrame([], "x int").count()
        jsonl.numbered_lines(spark, str(tmp_path)).join(lines, "value").count()
        table = jsonl._split_table
        jsonl._split_table = lambda _: table(spark.read.text(str(tmp_path / "a.jsonl")).select(
            F.col("_metadata.file_path").alias(jsonl._PATH), F.col("_metadata.file_block_start").alias(jsonl._BLOCK),
            F.monotonically_increasing_id().alias(jsonl._ROW)))
        try:
            jsonl.numbered_lines(spark, str(tmp_path)).collect()
        finally:
            jsonl._split_table = table


def test_a_worker_makes_its_model_once(spark, tmp_path):
    log = str(tmp_path)

    def make():
        with open(f"{log}/{os.getpid()}", "a") as file:
            file.write("made\n")
        return lambda texts: [[t + "!"] for t in texts]

    prompts = spark.range(400).select("id", F.col("id").cast("string").alias("prompt")).repartition(80)
    made = prompting.generate(prompts, make)
    assert sorted((r["id"], r["output"]) for r in made.collect()) == [(i, f"{i}!") for i in range(400)]
    assert made.count() == 400
    logs = glob.glob(f"{log}/*")
    assert 1 <= len(logs) <= 16 and all(open(f).read() == "made\n" for f in logs)


def test_two_generators_are_kept_apart(spark):
    prompts = spark.range(20).select("id", F.lit("p").alias("prompt")).repartition(8)
    for mark in "ab":
        made = prompting.generate(prompts, lambda mark=mark: lambda texts: [[mark] for _ in texts])
        assert {r["output"] for r in made.collect()} == {mark}


def test_sql_functions_run_no_python(spark):
    for name in ("sql_is_equiv", "sql_pass_at_k", "sql_choice_letter"):
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "Python" not in plan and "Arrow" not in plan


def test_sql_functions_take_odd_values(spark):
    sql.register(spark)
    texts = [None, "", " \n ", "Answer: x y", "\\boxed{ {1} } '", "it's 5", "٣/٤", "答案：7。", "a" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.createOrReplaceTempView("odd")
    from gradeframe.functions.equivalence import normalize_answer
    from gradeframe.functions.extract import extract_answer
    assert rows(spark.sql("SELECT gradeframe_extract_answer(t) a, gradeframe_normalize_answer(t) b FROM odd")) == rows(
        df.select(extract_answer("t").alias("a"), normalize_answer("t").alias("b")))
    grid = spark.range(1, 30).selectExpr("id * 9 AS n", "explode(sequence(0, 200, 23)) AS c").selectExpr(
        "n", "CAST(c AS BIGINT) AS c", "explode(sequence(-3L, 300L, 29L)) AS k").where("c <= n")
    grid.withColumn("want", passk.pass_at_k("n", "c", "k")).createOrReplaceTempView("grid")
    assert spark.sql("SELECT max(abs(want - gradeframe_pass_at_k(n, c, k))) AS d FROM grid").first()["d"] < 1e-12


def test_partition_folders(spark, tmp_path):
    path = str(tmp_path / "data")
    df = spark.range(60).selectExpr("id", "'t' AS text", "concat('b', id % 3) AS benchmark", "concat('s_', id % 4) AS checkpoint")
    df.write.partitionBy("benchmark", "checkpoint").parquet(path)
    got = discovery.read_partitions(spark, path, ["b0", "b2"], ["s_1"], schema="id bigint, text string")
    assert "PartitionFilters: [" in plan_of(got) and "benchmark" in plan_of(got).split("PartitionFilters")[1][:200]
    assert sorted(r["id"] for r in got.collect()) == [i for i in range(60) if i % 3 != 1 and i % 4 == 1]
    report = discovery.partition_report(discovery.read_partitions(spark, path), ["b0", "b1", "zz"])
    assert "ReadSchema: struct<>" in plan_of(report)
    assert rows(report) == [("b0", True), ("b1", True), ("zz", False)]
    steps = discovery.partition_report(spark.read.parquet(path), ["s_0", "s_9"], "checkpoint")
    assert rows(steps) == [("s_0", True), ("s_9", False)]


def test_levels_expand_the_histogram_only(spark):
    plan = plan_of(QUERIES["report_levels"](spark, FOLDER))
    assert plan.count("Expand ") == 1 and plan.index("Expand ") < plan.index("FileScan")
    scores = spark.createDataFrame([("m", "a", 4, 2), ("m", "a", 0, 0), ("m", "b", 1, 1), (None, "a", 2, 0)],
                                   "model string, benchmark string, n long, c long")
    got = {(r["level"], r["model"], r["benchmark"]): (r["total_examples"], r["pass_at_k"]) for r in
           scoring.report_levels(scores).collect()}
    assert got == {("model,benchmark", "m", "a"): (2, 0.5), ("model,benchmark", "m", "b"): (1, 1.0),
                   ("model,benchmark", None, "a"): (1, 0.0), ("model", "m", None): (3, 0.75),
                   ("model", None, None): (1, 0.0), ("all", None, None): (4, 0.5)}


def test_equal_answers_are_judged_with_their_number(spark):
    samples = spark.createDataFrame([(1, "5"), (1, "5"), (1, "5.0"), (1, None), (2, "x"), (9, "5")], "id long, answer_text string")
    questions = spark.createDataFrame([(1, "5"), (2, "y"), (3, ""), (4, None)], "id long, gold string")
    got = scoring.score_answers(samples, questions, ["id"])
    assert rows(got) == [(1, 4, 3), (2, 1, 0), (3, 0, 0), (4, 0, 0)]
    plan = plan_of(QUERIES["passk_empty_examples"](spark, FOLDER))
    assert plan.split("== Initial Plan")[0].count("FileScan") == 2


def test_exact_binomials(spark):
    pairs = [(60, 30), (100, 50), (0, 0), (5, 7), (7, -1), (90, 3), (1000, 2), (64, 32)]
    df = spark.createDataFrame(pairs, "n long, k long").select("n", "k", passk.exact_binomial("n", "k").alias("v"))
    for r in df.collect():
        assert int(r["v"]) == (math.comb(r["n"], r["k"]) if 0 <= r["k"] <= r["n"] else 0)
    assert spark.range(1).select(passk.exact_binomial(300, 150)).first()[0] is None


def test_the_entry_survives_a_missing_library():
    code = ("import sys; sys.modules['zstandard'] = None\nimport __spark_entry__ as e\n"
            "from gradeframe.catalog import QUERIES\nassert QUERIES.keys() == e.queries().keys() == e.oracle_sql().keys()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def sample_files(spark, path, output="Answer: 5"):
    spark.range(40).selectExpr("'m' AS model", "'260101000000' AS run_ts", "id AS example_id", f"'{output}' AS output",
                               "CAST(id % 7 AS STRING) AS gold").repartition(4).write.json(path)


SCHEMA = "model string, run_ts string, example_id long, output string, gold string"


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    sample_files(spark, source)

    def run():
        streaming.append_batches(streaming.read_generation_stream(spark, source, SCHEMA), out, state).awaitTermination()

    run()
    first = rows(spark.read.parquet(out).drop("batch"))
    assert len(first) == 40
    for commit in glob.glob(f"{state}/commits/*") + glob.glob(f"{state}/commits/.*crc"):
        os.remove(commit)  # written, but the stream failed before it could say so
    run()
    assert rows(spark.read.parquet(out).drop("batch")) == first
    run()
    assert rows(spark.read.parquet(out).drop("batch")) == first


def test_choices_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    from gradeframe.catalog.rollouts import choice_rollouts
    samples = choice_rollouts(spark, FOLDER).select(
        "example_id", "line_no", "part_key", "output", "labels", F.lit("m").alias("model"), F.lit("r").alias("run_ts"))
    samples.write.parquet(source)
    stream = spark.readStream.schema(samples.schema).parquet(source)
    streaming.append_batches(stream, out, state, lambda s: streaming.choice_stream(s, "labels")).awaitTermination()
    keys = ["example_id", "line_no", "part_key", "choice"]
    assert rows(spark.read.parquet(out).select(*keys)) == rows(
        extraction.extract_choices(samples, labels="labels").select(*keys))
