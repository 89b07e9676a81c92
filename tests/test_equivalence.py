"""Normal form, number parsing, equivalence."""

import math
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gradeframe.functions import equivalence
from gradeframe.operators.scoring import judge, parse_numbers
from helpers import apply

# Texts and the answers that they must give.
NORMAL = [
    ("42", "42"), ("3.14", "3.14"), ("  42  ", "42"), (r"\frac{2}{3}", "2/3"), ("$100$", "100"),
    ("1,000", "1000"), ("Answer: 42", "answer:42"), ("(  3.14 )", "3.14"), ("==42。", "42"),
    (r"\frac{  10 }{  20 }", "10/20"), (None, ""), (r"\dfrac{1}{2}", "d1/2"), ("1,2,3", "12,3"),
    ("((((42))))", "(42)"), ("(42).", "(42)"), ("(42)", "42"), ("()", ""), ("(())", ""),
    ("((1)", "(1"), ("a\u00a0b\u2003c\x1f", "abc"), ("５０％", "５０％"), ("İ", "i\u0307"),
    ("x=5", "x=5"), ("7．。!！", "7"), ("٣,٤", "٣٤"),
]


def test_normal_form(spark):
    got = apply(spark, equivalence.normalize_answer("t"), [c[0] for c in NORMAL])
    assert got == [c[1] for c in NORMAL]


PIECES = st.lists(st.sampled_from(["frac{", "\\frac{", "{", "}", "}{", "}", "1", "$", "/"]),
                  max_size=14).map("".join)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(PIECES, min_size=300, max_size=300))
def test_fractions_agree_with_python(spark, texts):
    want = [re.sub(r"frac\{([^}]+)\}\{([^}]+)\}", r"\1/\2", t.replace("\\", "")).replace("$", "")
            for t in texts]
    assert apply(spark, equivalence.normalize_answer("t"), texts) == want


def test_repetition_loops_take_linear_time(spark):
    start = time.monotonic()
    verdicts(spark, [(p, "1") for p in ("frac{" * 200_000, "frac{" * 200_000 + "}", "frac{1}{" * 100_000,
                                        "(" * 500_000, "1," * 300_000, "1_" * 300_000, "9" * 500_000)])
    assert time.monotonic() - start < 30


NUMBERS = [
    ("42", 42.0), ("-1.5e3", -1500.0), ("1.", 1.0), (".5", 0.5), ("2/3", 2 / 3), ("50%", 0.5),
    ("1/0", None), ("0/0", None), ("1/2/3", None), ("1_000", 1000.0), ("1__0", None), ("_1", None),
    ("1d", None), ("0x1p3", None), ("1f", None), ("inf", math.inf), ("-infinity", -math.inf),
    ("+inf", math.inf), ("1e999", math.inf), ("1/-2", -0.5), ("%", None), ("5%%", None), ("", None),
    ("1/2%", None), ("４２", 42.0), ("٣/٤", 0.75), ("e5", None), ("1e", None), ("1/", None),
    ("/2", None), ("infinit", None), ("1_0.0_1e1_0", 10.01e10), ("-_1", None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = [r["number"] for r in parse_numbers(df, "t").orderBy("i").collect()]
    assert got == pytest.approx([n for _, n in NUMBERS])


def test_nan_is_a_number(spark):
    df = spark.createDataFrame([(t,) for t in ["nan", "-nan", "+nan", "inf/inf"]], "t string")
    assert all(math.isnan(r["number"]) for r in parse_numbers(df, "t").collect())


def verdicts(spark, pairs, **options):
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)],
                               "i int, answer_text string, gold string").repartition(3)
    return [r["is_correct"] for r in judge(df, **options).orderBy("i").collect()]


EQUIVALENT = [
    ("42", "42", True), ("0.5", "50%", True), ("2/3", r"\frac{2}{3}", True),
    ("The answer is 42.", "42", True), ("0.6666666667", "2/3", True), ("1e3", "1000", True),
    ("1,000", "1000", True), ("abc", "def", False), ("42", "43", False),
    ("x=12", "2", True), ("12", "2", False), (None, "", True), (None, None, True), (None, "1", False),
    ("inf", "infinity", False), ("nan", "nan", True), ("nan", "1", False), ("abc", "", False),
    ("1.0000005", "1", True), ("1.000002", "1", False), ("42", "42.0", True), ("TRUE", "true", True),
]


def test_equivalence(spark):
    assert verdicts(spark, [c[:2] for c in EQUIVALENT]) == [c[2] for c in EQUIVALENT]


def test_strict_needs_more_than_containment(spark):
    assert verdicts(spark, [("x=12", "2"), ("1e3", "1000")], strict=True) == [False, True]
