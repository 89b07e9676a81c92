"""Random texts through the Spark expressions and through their SQL twins."""

import random

import duckdb
import pyarrow as pa
import pytest

from gradeframe.catalog import oracle
from gradeframe.operators.extraction import extract_answers, extract_choices
from gradeframe.operators.scoring import judge

ANSWER_TOKENS = ["\\boxed{", "\\frac{", "{", "}", "}{", "Answer:", "ANSWER: ", "final answer is", ":",
                 "答案：", "最终答案", "是", " ", "\n", "\n\n", "\t", "\r", "　", "1", "42", "3.5", "-", "/", ".",
                 ",", "。", "x", "the ", "!", "0", "1/2"]
VALUE_TOKENS = ["1", "2", "10", ".", ",", "/", "%", "-", "+", "e", "E", "_", "(", ")", "=", "$", "\\", " ", "x",
                "frac{", "}", "{", "inf", "nan", "infinity", "。", "!", "0", "5"]
CHOICE_TOKENS = ["answer", "Answer", "ANSWER", "is", "IS", "correct", "Correct", "option", "Choice", ":", " ",
                 "  ", "(", ")", "[", "]", "A", "B", "C", "D", "E", "a", "b", "c", "d", "e", "\n", "_", ".",
                 "é", "1", "zz", "F", "-", "\t"]


def texts(tokens, count, longest, seed):
    draw = random.Random(seed)
    return ["".join(draw.choices(tokens, k=draw.randrange(longest + 1))) for _ in range(count)]


def duck(columns, sql):
    connection = duckdb.connect()
    connection.register("given", pa.table({"i": list(range(len(next(iter(columns.values()))))), **columns}))
    return connection.execute(sql).fetchall()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_extraction(spark, seed):
    given = texts(ANSWER_TOKENS, 4000, 14, seed)
    want = duck({"output": given}, f"""SELECT i, output, {oracle.answer('output')},
        {oracle.strategy('output')} FROM given ORDER BY i""")
    df = spark.createDataFrame(list(enumerate(given)), "i long, output string").repartition(8)
    got = extract_answers(df, strategy="strategy").select(
        "i", "output", "answer_text", "strategy").orderBy("i").collect()
    different = [(tuple(g), w) for g, w in zip(got, want) if tuple(g) != w]
    assert not different, different[:3]


@pytest.mark.parametrize("seed", [3, 4])
def test_equivalence(spark, seed):
    pred, gold = texts(VALUE_TOKENS, 6000, 7, seed), texts(VALUE_TOKENS, 6000, 4, seed + 100)
    source = oracle.judged("given", "answer_text", "gold")
    want = duck({"answer_text": pred, "gold": gold},
                f"SELECT i, answer_text, gold, is_correct FROM {source} ORDER BY i")
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(zip(pred, gold))],
                               "i long, answer_text string, gold string").repartition(8)
    got = judge(df).orderBy("i").collect()
    different = [(tuple(g), w) for g, w in zip(got, want) if tuple(g) != w]
    assert not different, different[:3]
    assert 300 < sum(w[3] for w in want) < 5000


@pytest.mark.parametrize("labels", [list("ABCDE"), list("ABCD"), list("EDCBA")])
def test_choices(spark, labels):
    given = texts(CHOICE_TOKENS, 6000, 10, len(labels))
    want = duck({"output": given, "labels": [labels] * len(given)},
                f"SELECT i, output, {oracle.choice('output', 'labels', labels)} FROM given ORDER BY i")
    df = spark.createDataFrame([(i, t, labels) for i, t in enumerate(given)],
                               "i long, output string, labels array<string>").repartition(8)
    got = extract_choices(df, labels="labels").select("i", "output", "choice").orderBy("i").collect()
    different = [(tuple(g), w) for g, w in zip(got, want) if tuple(g) != w]
    assert not different, different[:3]
    assert len({w[2] for w in want}) == len(labels) + 1
