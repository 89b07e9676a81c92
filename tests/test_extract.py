"""Answer extraction: golden rows, quirks and agreement with Python's regex engine."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from gradeframe.functions import extract, text
from gradeframe.operators.extraction import extract_answers
from helpers import apply

# Texts and the answers that they must give.
GOLDEN = {
    "boxed": (lambda: extract.boxed_answer("t"), [
        (r"The answer is \boxed{42}", "42"),
        (r"Step 1... Step 2... Therefore \boxed{3.14}", "3.14"),
        (r"\boxed{1/2} is the first, \boxed{3/4} is final", "3/4"),
        ("No boxed answer here", None),
        (r"\boxed{\frac{1}{2}}", r"\frac{1"),
        (r"\boxed{ }", ""),
        ("\\boxed{\u3000 7\x1f}", "7"),
        (r"\boxed{a \boxed{b}", r"a \boxed{b"),
        (None, None),
    ]),
    "balanced": (lambda: extract.boxed_answer("t", balanced=True), [
        (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}"),
        (r"\boxed{\sqrt{\frac{1}{2}}} end", r"\sqrt{\frac{1}{2}}"),
        (r"\boxed{42}", "42"),
    ]),
    "fraction": (lambda: extract.latex_fraction("t"), [
        (r"The answer is \frac{14}{3}", r"\frac{14}{3}"),
        (r"Step 1: \frac{1}{2}, Step 2: \frac{2}{3}", r"\frac{2}{3}"),
        ("No LaTeX fraction here", None),
        (r"Partial: \frac{14}", None),
    ]),
    "marker": (lambda: extract.marked_answer("t"), [
        ("The calculation shows Answer: 42", "42"),
        ("答案：123", "123"),
        ("The final answer is: 3.14", "3.14"),
        ("最终答案是：2/3", "：2/3"),
        ("No answer marker", None),
        ("Answer:   ", None),
        ("Answer: .\nfinal answer is 7", "7"),
        ("Answer:\n\n 12 。", "12"),
        ("ANSWER: x\nAnswer: y !", "y"),
        ("Answer: a\rb\x85c", "a"),
        ("Answer: 42. .", "42."),
        ("Answer: 1\rAnswer: 2", "1"),
        ("Answer: 5\nAnswer:\r", None),
        ("Answer: 5\nAnswer: ", None),
    ]),
    "number": (lambda: extract.last_number("t"), [
        ("The answer is 42 and that's final", "42"),
        ("We get 3.14159 as result", "3.14159"),
        ("The fraction is 2/3", "2/3"),
        ("First 10, then 20, finally 30", "30"),
        ("No numbers here", None),
        ("it is 42.", None),
        ("step 7\nThe value is 3.", "7"),
        ("1,000", "000"),
        ("on 1/2/2024 we had 3.5", "1/2"),
        ("5-3.2", "3.2"),
        ("5-3/4", "-3/4"),
        ("a -5 b", "-5"),
        ("5-7", "7"),
        ("1.2.3", "1.2"),
    ]),
    "last_line": (lambda: extract.last_line("t"), [
        ("Just text\nFinal line", "Final line"),
        ("a\n\n  b c \n \t\n", "b c"),
        ("   \n ", ""),
        ("", ""),
    ]),
    "cascade": (lambda: extract.extract_answer("t"), [
        (r"Therefore \boxed{42}", "42"),
        (r"The answer is \frac{14}{3}", r"\frac{14}{3}"),
        ("Answer: 100", "100"),
        ("The result is 3.14", "3.14"),
        ("Just text\nFinal line", "Final line"),
        (r"so \frac{1}{2} holds. Answer: 9", r"\frac{1}{2}"),
        (r"\boxed{ } then Answer: 8", "8"),
        ("", ""),
        (None, None),
    ]),
}


@pytest.mark.parametrize("rule", GOLDEN)
def test_golden(spark, rule):
    expression, cases = GOLDEN[rule]
    assert apply(spark, expression(), [c[0] for c in cases]) == [c[1] for c in cases]


def test_marker_ignores_case_as_python_does(spark):
    texts = ["anſwer: 5", "ANSWER: 6", "Fınal answer is 7", "FİNAL ANSWER IS: 8"]
    want = []
    for t in texts:
        found = (re.findall(r"Answer:\s*(.+)", t, re.I)
                 or re.findall(r"final answer is:?\s*(.+)", t, re.I))
        want.append(found[-1] if found else None)
    assert apply(spark, extract.marked_answer("t"), texts) == want


# Our pattern, the plain spelling for Python, and the group that holds the match.
# Texts and the answers that they must give.
PATTERNS = [
    (extract.FRACTION_NUMBER, r"-?\d+/\d+", 0),
    (extract.DECIMAL_NUMBER, r"(?<![\d])(-?\d+\.\d+)(?![\d])", 0),
    (extract.INTEGER_NUMBER, r"(?<![\d])(-?\d+)(?![\d\.])", 0),
]
FOUND = [
    (extract.BOXED, r"\\boxed\{([^}]+)\}"),
    (extract.LATEX_FRACTION, r"(\\frac\{[^}]+\}\{[^}]+\})"),
]
TEXT = st.lists(st.sampled_from(
    ["1", "23", "-", ".", "/", ",", " ", "a", "\n", "٣", "²", "\x85"]), max_size=12).map("".join)
BRACES = st.lists(st.sampled_from(["\\boxed{", "\\frac{", "{", "}", "}", "1", "\n"]),
                  max_size=14).map("".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=150, max_size=150))
def test_patterns_agree_with_python(spark, texts):
    for ours, plain, group in PATTERNS:
        got = apply(spark, extract.last_match("t", ours, group), texts)
        want = [next(iter(re.findall(plain, t)[::-1]), None) for t in texts]
        assert got == want, plain


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BRACES, min_size=300, max_size=300))
def test_brace_patterns_agree_with_python(spark, texts):
    for ours, plain in FOUND:
        got = apply(spark, text.last_found("t", ours), texts)
        want = [next(iter(re.findall(plain, t)[::-1]), None) for t in texts]
        assert got == want, plain


def test_repetition_loops_take_linear_time(spark):
    loops = [r"\frac{" * 200_000, r"\boxed{" * 200_000, r"\frac{" * 200_000 + "}", r"\frac{1}{" * 100_000,
             "Answer: " * 100_000, "-" * 500_000, "1." * 200_000, "答案" * 200_000]
    start = time.monotonic()
    apply(spark, extract.extract_answer("t"), loops)
    assert time.monotonic() - start < 30


def test_staged_strategies_equal_the_cascade(spark):
    texts = [c[0] for _, cases in GOLDEN.values() for c in cases]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, output string")
    staged = extract_answers(df, strategy="strategy").orderBy("i").collect()
    plain = extract_answers(df).orderBy("i").collect()
    assert [r["answer_text"] for r in staged] == [r["answer_text"] for r in plain]
    by_text = {r["output"]: r["strategy"] for r in staged}
    assert by_text[r"Therefore \boxed{42}"] == "boxed"
    assert by_text[r"\boxed{ } then Answer: 8"] == "marker"
    assert by_text["The result is 3.14"] == "number"
    assert by_text[""] == "last_line"
    assert by_text[None] is None


def test_long_texts_do_not_overflow(spark):
    long = "word " * 200_000
    texts = [long + r"\boxed{7}", long + "3/4", "9" * 300_000, "\n" * 300_000 + "x", long + "A😀" * 9]
    got = apply(spark, extract.extract_answer("t"), texts)
    assert got[0] == "7" and got[1] == "3/4" and got[2] == "9" * 300_000 and got[3] == "x"
