"""Choice letters: golden rows and the order of the rules."""

from pyspark.sql import functions as F

from gradeframe.functions import choice
from gradeframe.operators.extraction import extract_choices

# Texts and the answers that they must give.
GOLDEN = [
    ("The answer is (C).", "C"), ("Answer: Because of D", "B"), ("correct option B", "B"),
    ("Choice D", "D"), ("I pick (E) over (A)", "E"), ("[B]", "B"), ("  c  ", "C"),
    ("a dog\nB", "A"), ("ab\nB) yes", "B"), ("Well, C beats B", "B"), ("only zzd", "D"),
    ("why not go b or c", "C"), ("hmm_A_ bb", "A"), ("éA x b", "B"),
    ("the answer: (G) or (B)", "B"), ("xyz", None), ("", None), ("because", None), (None, None),
    ("ANSWER IS : e", "E"), ("answer IS E", "E"), ("\x1f b\x85", "B"), ("1\n\u3000d.\r\n", "D"),
    ("x A\u0301", "A"), ("CORRECT:: (D", "D"),
]


def letters(spark, cases, labels=None):
    rows = [(i, t, labels) for i, t in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, output string, labels array<string>").repartition(3)
    found = extract_choices(df, labels="labels" if labels else None)
    return [r["choice"] for r in found.orderBy("i").collect()]


def test_golden(spark):
    assert letters(spark, [c[0] for c in GOLDEN]) == [c[1] for c in GOLDEN]


def test_labels_of_the_row(spark):
    texts = ["The answer is (E).", "(E) or [B]", "only d and e", "E\nC"]
    assert letters(spark, texts, ["A", "B", "C", "D"]) == ["A", "B", None, "C"]


def test_first_match_of_a_phrase_decides(spark):
    # The first "(X)" is no label, later ones of the same phrase are not tried.
    assert letters(spark, ["(E) (B) zz"], ["A", "B", "C", "D"]) == ["B"]
    assert letters(spark, ["see (E), (B)b"], ["A", "C", "B"]) == ["B"]


def test_word_rule_uses_label_order(spark):
    assert letters(spark, ["Maybe D or A"], ["D", "A"]) == ["D"]
    assert letters(spark, ["Maybe D or A"], ["A", "D"]) == ["A"]


def test_last_occurrence_needs_free_sides(spark):
    # Upper case: "GO B, OR BE" ends in a bound B; C has a free last occurrence.
    assert letters(spark, ["go b, or c, or be"], ["A", "B", "C"]) == ["C"]
    assert letters(spark, ["xb_ cc"], ["B", "C"]) == [None]
    assert letters(spark, ["x_b_ cc"], ["B", "C"]) == ["B"]


def test_long_text(spark):
    long = "😀 lorem ipsum " * 50_000
    assert letters(spark, [long + "[D]", long + " b"]) == ["D", "B"]


def test_labels_of_several_words(spark):
    df = spark.createDataFrame([
        (0, "It is in New York today", ["New York", "Paris"]), (1, "NewYork", ["New York", "Paris"]),
        (2, "we took C++ then", ["C", "C++"]), (3, "go to B now", ["New York", "B"]),
        (4, "a.b and axb", ["axb", "a.b"])], "i int, t string, labels array<string>")
    got = df.select("i", choice.word_choice("t", F.col("labels")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["New York", None, "C", "B", "axb"]
