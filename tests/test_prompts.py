"""Prompts, sampling parameters, fan-out and batch generation."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import prompts
from gradeframe.operators import prompting
from gradeframe.plans import choice_eval, math_eval
from helpers import apply, rows


def test_model_name(spark):
    paths = ["/a/b/M-8B/", "M-8B", "org/M//", "/"]
    assert apply(spark, prompts.model_name("t"), paths) == [
        p.rstrip("/").split("/")[-1] for p in paths]


def test_modes(spark):
    df = spark.createDataFrame([("q", "think"), ("q", "nothink"), ("q", "odd")], "q string, m string")
    got = df.select(prompts.chat_messages("q", "m").alias("x")).collect()
    assert [r["x"][0]["content"] for r in got] == ["q /think", "q /no_think", "q /no_think"]
    assert got[0]["x"][0]["role"] == "user"


def test_choice_prompt_cuts_to_the_shorter_list(spark):
    items = spark.createDataFrame(
        [("q?", (["A", "B", "C"], ["x", "y"])), ("r", (["A"], ["x", "y"])), ("s", ([], []))],
        "question string, choices struct<label: array<string>, text: array<string>>")
    table = choice_eval.choice_prompts(items, "think", k=8)
    contents = {r["question"]: r["messages"][0]["content"] for r in table.collect()}
    end = "\n\nAnswer with only the letter (A, B, C, D, or E). /think"
    assert contents == {"q?": "q?\n\nA. x\nB. y" + end, "r": "r\n\nA. x" + end, "s": "s\n\n" + end}
    assert rows(table.select("max_tokens", "n", "temperature").distinct()) == [(8192, 8, 0.6)]


def test_math_prompts(spark):
    items = spark.createDataFrame([("q", b) for b in ("aime24", "math500", "new")],
                                  "question string, benchmark string")
    table = math_eval.math_prompts(items, "nothink", k=32)
    got = table.select("benchmark", "temperature", "top_p", "top_k", "presence_penalty", "max_tokens", "n")
    assert rows(got) == [("aime24", 0.7, 0.8, 20, 1.5, 38912, 32), ("math500", 0.7, 0.8, 20, 1.5, 32768, 32),
                         ("new", 0.7, 0.8, 20, 1.5, 32768, 32)]


def test_unknown_mode_fails(spark):
    with pytest.raises(Exception, match="unknown mode: fast"):
        prompting.with_sampling(spark.createDataFrame([("fast",)], "mode string"), 1).collect()


def test_fan_out(spark):
    got = prompting.fan_out(spark.createDataFrame([(1,), (2,)], "example_id int"), 3)
    assert rows(got) == [(e, i) for e in (1, 2) for i in range(3)]


def test_generation_keeps_keys_and_batches(spark):
    def make():
        def answer(texts):
            return [[f"{t}|{len(texts)}|{i}" for i in range(2)] for t in texts]
        return answer

    df = spark.range(10).select(F.col("id").alias("example_id"),
                                F.concat(F.lit("p"), "id").alias("prompt")).coalesce(1)
    got = prompting.generate(df, make, batch_size=4).collect()
    assert {(r["example_id"], r["sample_idx"]) for r in got} == {(e, i) for e in range(10) for i in (0, 1)}
    assert all(r["output"].startswith(f"p{r['example_id']}|") for r in got)
    assert {int(r["output"].split("|")[1]) for r in got} == {4, 2}


def test_generation_checks_the_result(spark):
    df = spark.createDataFrame([(1, "p")], "example_id int, prompt string")
    with pytest.raises(Exception, match="0 results for 1 prompts"):
        prompting.generate(df, lambda: lambda texts: []).collect()


SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from gradeframe.session import local_session
from gradeframe.catalog import QUERIES
print("rows", QUERIES["generate_stub"](local_session(1), "/root/testdata/sf0.001").count())
"""


def test_workers_do_not_need_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, timeout=120,
                          capture_output=True, text=True)
    assert "rows 144" in done.stdout, done.stderr[-500:]


def test_generation_keeps_other_columns_as_they_are(spark):
    from decimal import Decimal
    rows_ = [(1152921504606846977, "a", Decimal("1.10"), ["x", None]), (None, "b", None, None)]
    df = spark.createDataFrame(rows_, "id long, prompt string, price decimal(10,2), tags array<string>").withColumn(
        "at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    got = prompting.generate(df, lambda: lambda prompts: [[p, p * 2] for p in prompts])
    kept = ["id", "price", "tags", "at"]
    assert rows(got.select(*kept)) == rows(df.select(*kept).unionByName(df.select(*kept)))
    assert rows(got.select("sample_idx", "output")) == [(0, "a"), (0, "b"), (1, "aa"), (1, "bb")]
