"""From extracted answers to verdicts, per-example counts and Pass@k.

Samples are judged in a projection, counted per example with partial
aggregation, and then folded into a histogram of (n, c). Pass@k is evaluated on
the histogram, whose size depends on the number of distinct sample counts and
not on the number of examples.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.functions import equivalence, passk
from gradeframe.operators.layout import explode_range


def judge(df: DataFrame, pred: str = "answer_text", gold: str = "gold", name: str = "is_correct",
          strict: bool = False, gold_normal: str | None = None) -> DataFrame:
    """Add the equivalence verdict of each sample.

    Intermediate columns are named, so each regex chain runs once. Numbers are
    parsed only where the normal forms differ. ``gold_normal`` names a column
    that already holds the normalised gold answer.
    """
    gold_form = F.col(gold_normal) if gold_normal else equivalence.normalize_answer(gold)
    differ = F.col("__p") != F.col("__g")
    # Two more stages, so that a text is checked against the grammar once.
    pred_text = F.when(differ, equivalence.numeric_text("__p"))
    gold_text = F.when(F.col("__pt").isNotNull(), equivalence.numeric_text("__g"))
    return (df.withColumns({"__p": equivalence.normalize_answer(pred), "__g": gold_form})
            .withColumn("__pt", pred_text).withColumn("__gt", gold_text)
            .withColumns({"__pn": equivalence.numeric_value("__pt"),
                          "__gn": equivalence.numeric_value("__gt")})
            .withColumn(name, equivalence.verdict("__p", "__g", "__pn", "__gn", strict))
            .drop("__p", "__g", "__pt", "__gt", "__pn", "__gn"))


def parse_numbers(df: DataFrame, text: str, name: str = "number") -> DataFrame:
    """Add the value of a text in normal form, NULL if it is no number."""
    return (df.withColumn("__text", equivalence.numeric_text(text))
            .withColumn(name, equivalence.numeric_value("__text")).drop("__text"))


def attach_gold(samples: DataFrame, questions: DataFrame, keys: Sequence[str],
                gold: str = "gold") -> DataFrame:
    """Bring the gold answer and its normal form to each sample.

    Gold answers are normalised once per question, before the join. An example
    with very many samples is split by Spark's own handling of skewed joins.
    """
    side = questions.select(*keys, gold,
                            equivalence.normalize_answer(gold).alias("gold_normal"))
    return samples.join(side, list(keys))


def example_scores(judged: DataFrame, keys: Sequence[str], verdict: str = "is_correct",
                   position: str | None = None) -> DataFrame:
    """Samples n and correct samples c of each example.

    With ``position``, a row without one stands for an example without samples.
    """
    if position is None:
        n, right = F.count(F.lit(1)), F.col(verdict)
    else:
        n, right = F.count(position), F.col(verdict) & F.col(position).isNotNull()
    return judged.groupBy(*keys).agg(n.alias("n"), F.count_if(right).alias("c"))


def with_empty_examples(scores: DataFrame, questions: DataFrame,
                        keys: Sequence[str]) -> DataFrame:
    """Add questions without any sample as n = 0, c = 0."""
    return (questions.select(*keys).join(scores, list(keys), "left")
            .withColumns({"n": F.coalesce("n", F.lit(0)), "c": F.coalesce("c", F.lit(0))}))


def score_answers(answered: DataFrame, questions: DataFrame, keys: Sequence[str], answer: str = "answer_text",
                  gold: str = "gold", strict: bool = False) -> DataFrame:
    """n and c of every question, from samples and gold answers in two tables, in one join.

    Equal answers of an example are counted before they move and judged once,
    with their number as weight. A question without samples has n = 0 and c = 0;
    samples without a question are left out.
    """
    counts = answered.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("__votes"))
    asked = questions.select(*keys, gold, equivalence.normalize_answer(gold).alias("__gold"))
    judged = judge(asked.join(counts, list(keys), "left"), answer, gold, "__right", strict, gold_normal="__gold")
    right = F.when(F.col("__right"), F.col("__votes"))
    return judged.groupBy(*keys).agg(F.coalesce(F.sum("__votes"), F.lit(0)).alias("n"),
                                     F.coalesce(F.sum(right), F.lit(0)).alias("c"))


def example_pass_at_k(scores: DataFrame, ks: Sequence[int] | None = None) -> DataFrame:
    """Pass@k of each example for k = 1..n, or for the given ks clamped to n.

    Without ``ks`` the counts, one row per example or per block of a large one,
    are dealt anew before they are expanded, so that the rows of an example
    with very many samples are produced by many tasks. Treating such examples
    apart would judge all samples twice.
    """
    if ks is None:
        ranged = explode_range(scores, "n", "k", spread=True)
    else:
        ranged = scores.where("n > 0").withColumn("k", F.explode(_k_array(ks)))
    return ranged.withColumn("pass_at_k", passk.pass_at_k("n", "c", "k"))


def _k_array(ks: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(k)).cast("long") for k in ks])


def score_histogram(scores: DataFrame, by: Sequence[str] = ("benchmark",),
                    order_by: str | None = None) -> DataFrame:
    """Number of examples per (n, c), with the first example if an order is named."""
    first = [F.min(order_by).alias("first_example")] if order_by else []
    return scores.groupBy(*by, "n", "c").agg(F.count(F.lit(1)).alias("examples"), *first)


def _short_of(k: str = "k", n: str = "n") -> Column:
    message = F.concat(F.lit("an example has only "), F.col(n).cast("string"),
                       F.lit(" samples, Pass@"), F.col(k).cast("string"), F.lit(" is undefined"))
    return F.when((F.col(n) > 0) & (F.col(n) < F.col(k)), F.raise_error(message).cast("double"))


def _with_ks(scores: DataFrame, by: list[str], ks: Sequence[int] | None, order_by: str,
             start: Sequence[int]) -> DataFrame:
    """Histogram rows times k; ``start`` adds further values in front."""
    if ks is not None:
        return score_histogram(scores, by).withColumn("k", F.explode(_k_array([*start, *ks])))
    histogram = score_histogram(scores, by, order_by)
    grouped = by or ["__all"]
    if not by:
        histogram = histogram.withColumn("__all", F.lit(0))
    # The list is 1..n of the first example that has samples, found on the histogram itself.
    first = F.min(F.when(F.col("n") > 0, F.struct("first_example", "n"))).over(Window.partitionBy(*grouped))
    ranged = (histogram.withColumn("__last", F.coalesce(first["n"], F.lit(0)))
              .drop("first_example"))
    return explode_range(ranged, "__last", "k", first=min([*start, 1]))


def _mean_at_k(scores: DataFrame, by: list[str], ks: Sequence[int] | None, on_short: str,
               order_by: str, start: Sequence[int] = ()) -> DataFrame:
    if on_short not in ("error", "drop", "clamp"):
        raise ValueError(f"on_short must be error, drop or clamp, not {on_short!r}")
    ranged = _with_ks(scores, by, ks, order_by, start)
    value = passk.pass_at_k("n", "c", "k")
    if on_short == "error":
        value = F.coalesce(_short_of(), value)
    counted = F.col("n") > 0
    if on_short == "drop":
        counted = counted & (F.col("k") <= F.col("n"))
    weight = F.when(counted, F.col("examples"))
    return (ranged.withColumn("__value", value).groupBy(*by, "k")
            .agg(F.try_divide(F.sum(F.col("__value") * weight), F.sum(weight)).alias("pass_at_k"),
                 F.sum("examples").alias("examples"),
                 F.sum(F.when(F.col("c") > 0, F.col("examples")).otherwise(0)).alias("hits")))


def pass_at_k_by(scores: DataFrame, by: Sequence[str] = ("benchmark",),
                 ks: Sequence[int] | None = None, on_short: str = "error",
                 order_by: str = "example_id") -> DataFrame:
    """Mean Pass@k over the examples that have samples.

    Without ``ks`` the list is 1..n of the first example in ``order_by`` order.
    ``on_short`` says what happens to an example with fewer than k samples:
    'error' raises, 'drop' leaves it out of that k, 'clamp' uses its own n.
    """
    means = _mean_at_k(scores, list(by), ks, on_short, order_by)
    return means.where("pass_at_k IS NOT NULL").select(*by, "k", "pass_at_k")


def accuracy_any(scores: DataFrame, by: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Examples, examples with a correct sample, and their ratio (0 if none)."""
    hit = F.count_if(F.col("c") > 0)
    total = F.count(F.lit(1))
    return scores.groupBy(*by).agg(
        total.alias("total_examples"), hit.alias("correct_at_least_once"),
        F.coalesce(F.try_divide(hit, total), F.lit(0.0)).alias("accuracy_any"))


def _k_map(pairs: Column) -> Column:
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(
        F.concat(F.lit("pass@"), p["k"].cast("string")), p["pass_at_k"])))


def pass_at_k_map(table: DataFrame, by: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Fold long Pass@k rows into one ``pass@k -> value`` map, in order of k."""
    pairs = F.array_sort(F.collect_list(F.struct("k", "pass_at_k")))
    return table.groupBy(*by).agg(_k_map(pairs).alias("pass_at_k"))


def benchmark_summary(scores: DataFrame, by: Sequence[str] = ("benchmark",),
                      ks: Sequence[int] | None = None, on_short: str = "error",
                      order_by: str = "example_id") -> DataFrame:
    """One row per benchmark with counts, accuracy and the Pass@k map.

    Everything comes from one pass over the histogram: k = 0 carries the counts
    over all examples. A benchmark whose examples all lack samples keeps its
    counts and an empty map.
    """
    means = _mean_at_k(scores, list(by), ks, on_short, order_by, start=[0])
    filled = (F.col("k") > 0) & F.col("pass_at_k").isNotNull()
    pairs = F.array_sort(F.collect_list(F.when(filled, F.struct("k", "pass_at_k"))))
    total = F.max(F.when(F.col("k") == 0, F.col("examples")))
    hits = F.max(F.when(F.col("k") == 0, F.col("hits")))
    return (means.groupBy(*by)
            .agg(total.alias("total_examples"), hits.alias("correct_at_least_once"),
                 F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("accuracy_any"),
                 _k_map(pairs).alias("pass_at_k")))


def report_levels(scores: DataFrame, levels: Sequence[Sequence[str]] = (("model", "benchmark"), ("model",), ()),
                  ks: Sequence[int] = (1,)) -> DataFrame:
    """Counts, accuracy and mean Pass@k of several levels at once: (level, the levels' columns, k, ...).

    The histogram of (n, c) at the finest level serves them all; it is expanded
    once, and texts and examples are not touched again. ``level`` names the
    columns of a row's level, 'all' for none; columns above a level are NULL.
    Examples with fewer than k samples count with their own n.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    ranged = score_histogram(scores, columns).withColumn("k", F.explode(_k_array(ks)))
    weight = F.when(F.col("n") > 0, F.col("examples"))
    valued = ranged.withColumn("__value", passk.pass_at_k("n", "c", "k"))
    total, hits = F.sum("examples"), F.sum(F.when(F.col("c") > 0, F.col("examples")).otherwise(0))
    # The grouping id has a bit for each column that a level leaves out, the last one lowest; k is in all.
    width = len(columns)
    bits = {sum(1 << (width - i) for i, c in enumerate(columns) if c not in level): ",".join(level) or "all"
            for level in levels}
    name = F.coalesce(*[F.when(F.col("__id") == i, F.lit(n)) for i, n in bits.items()])
    grouped = valued.groupingSets([[*level, "k"] for level in levels], *columns, "k").agg(
        F.grouping_id().alias("__id"), total.alias("total_examples"), hits.alias("correct_at_least_once"),
        F.coalesce(F.try_divide(hits, total), F.lit(0.0)).alias("accuracy_any"),
        F.try_divide(F.sum(F.col("__value") * weight), F.sum(weight)).alias("pass_at_k"))
    return grouped.select(name.alias("level"), *columns, "k", "total_examples", "correct_at_least_once",
                          "accuracy_any", "pass_at_k")


def quick_results(summary: DataFrame, by: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Pass@1 and accuracy per benchmark, 0 where missing."""
    first = F.coalesce(F.try_element_at("pass_at_k", F.lit("pass@1")), F.lit(0.0))
    return summary.select(*by, first.alias("pass_at_1"),
                          F.coalesce("accuracy_any", F.lit(0.0)).alias("accuracy_any"))
