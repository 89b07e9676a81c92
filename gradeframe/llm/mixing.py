"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies that each of its
documents should have. Whole copies are certain. The rest is an inclusion
probability: documents are ranked by their random odds divided by their
inclusion odds, and the ranking is cut where the source's words are spent, so
each sample has a fixed size in words. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.common import stored, word_count

BINS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """Target of each source from (source, source_size): adds ``target``.

    Sources in code point order, NULL last, take the weights in turn and share
    ``share`` times all words by weight. No target exceeds ``most`` times its
    source's size; what is over goes to the others by weight. The filling level
    is found from running sums over the sources ordered by how soon they fill.
    The windows hold one row per source, not per document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = (F.row_number().over(order) - 1) % len(weights)
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rows = (sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
            .withColumn("most", F.col("source_size") * F.lit(float(most)))
            .withColumn("ratio", F.col("most") / F.col("weight"))
            .withColumn("all_words", F.sum("source_size").over(every) * F.lit(float(share))))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    after = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # If all sources before this one are full, the others fill to this level.
    rows = rows.withColumn("level", (F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                           / F.sum("weight").over(after))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return (rows.withColumn("level", first)
            .select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(
                F.least("most", F.col("level") * F.col("weight"))).alias("target")))


def draw(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from the id's digest, or from the text's if there is no id."""
    key = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _rank(draw_: Column, rest: Column, propensity: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, inf) to (0, 1); 1 if nothing is left."""
    odds = draw_ / (1 - draw_) * F.try_divide(1 - rest, rest) / propensity
    return F.coalesce(odds / (1 + odds), F.lit(1.0))


def plan(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
         most: float = 2.0) -> DataFrame:
    """One row per source from (source, size, draw, propensity).

    Gives source_size, target, ``certain`` whole copies, the inclusion
    probability ``rest``, and where the ranking is cut: ``cut_bin`` (NULL:
    nowhere) and ``cut_rank`` within that bin. The ranking is first cut into
    65,536 bins that are summed before they move; only the bin that holds the
    cut is looked at document by document, so a source with a third of all
    documents costs no more than the others.
    """
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    sources = sources.withColumn("certain", F.floor(rate).cast("long")).withColumn(
        "rest", rate - F.col("certain")).withColumn(
        "words_left", F.col("target") - F.col("certain") * F.col("source_size"))
    sources = stored(sources, "mix-sources")
    ranked = (sized.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source"))
              .select("d.source", "size", "words_left",
                      _rank(F.col("draw"), F.col("rest"), F.col("propensity")).alias("rank"))
              .withColumn("bin", F.floor(F.col("rank") * BINS).cast("int")))
    bins = (ranked.groupBy("source", "bin").agg(F.sum("size").alias("bin_words"), F.first("words_left").alias("left"))
            .withColumn("through", F.sum("bin_words").over(Window.partitionBy("source").orderBy("bin"))))
    cut = (bins.where("through > left").groupBy("source")
           .agg(F.min(F.struct("bin", (F.col("through") - F.col("bin_words")).alias("before"), "left")).alias("cut"))
           .select("source", "cut.*"))
    inside = (ranked.alias("d").join(cut.alias("c"), F.expr("d.source <=> c.source and d.bin = c.bin"))
              .groupBy("c.source", "rank").agg(F.sum("size").alias("words"), F.first("before").alias("before"),
                                               F.first("left").alias("left"))
              .withColumn("upto", F.col("before") + F.sum("words").over(
                  Window.partitionBy("source").orderBy("rank")))
              .where(F.col("upto") - F.col("words") / 2 <= F.col("left"))
              .groupBy("source").agg(F.max("rank").alias("cut_rank")))
    cut = cut.alias("c").join(inside.alias("i"), F.expr("c.source <=> i.source"), "left").select(
        "c.source", F.col("c.bin").alias("cut_bin"), F.coalesce("cut_rank", F.lit(-1.0)).alias("cut_rank"))
    done = sources.alias("s").join(cut.alias("c"), F.expr("s.source <=> c.source"), "left").select(
        "s.source", "source_size", "target", "certain", "rest", "cut_bin", "cut_rank")
    return stored(done, "mix-plan")


def _copies(rank: Column) -> Column:
    inside = (F.col("cut_bin").isNull() | (F.floor(rank * BINS) < F.col("cut_bin"))
              | (rank <= F.col("cut_rank")))
    return F.col("certain") + ((F.col("rest") > 0) & inside).cast("long")


def _sized(docs: DataFrame, propensity: Column | None) -> DataFrame:
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        draw(F.col("doc_id"), F.col("text")).alias("draw"),
        (propensity if propensity is not None else F.lit(1.0)).cast("double").alias("propensity"))


def copies(docs: DataFrame, propensity: Column | None = None, **options) -> DataFrame:
    """Copies that the mix takes of each document.

    Gives doc_id, source, size (words; 0 for NULL), source_size, target and
    copies, one row per document. ``propensity`` in (0, 1], if given, scales a
    document's inclusion odds, so that documents of one source are drawn with
    unequal probabilities; the cut keeps the source's size. Without it the
    documents of one source are alike and sources differ.

    A sample misses its target by half of the document at the cut at most. A
    NULL source is a source. Rows with equal draws (repeated rows) are taken
    together. Reruns agree, because draws come from digests. Texts are read
    once and never moved. Other columns are ignored.
    """
    rows = stored(_sized(docs, propensity), "mix-sizes")
    done = plan(rows, **options)
    rank = _rank(F.col("draw"), F.col("rest"), F.col("propensity"))
    return rows.alias("d").join(done.alias("s"), F.expr("d.source <=> s.source")).select(
        "doc_id", "d.source", "size", "source_size", "target", _copies(rank).alias("copies"))


def mix(docs: DataFrame, propensity: Column | None = None, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    The plan has one row per source; where Spark finds it small enough to
    broadcast, the documents are not shuffled.
    """
    done = plan(stored(_sized(docs, propensity), "mix-sizes"), **options)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "source",
                      draw(F.col("doc_id"), F.col("text")).alias("_draw"),
                      (propensity if propensity is not None else F.lit(1.0)).cast("double").alias("_p"))
    rank = _rank(F.col("_draw"), F.col("rest"), F.col("_p"))
    taken = own.alias("d").join(done.alias("s"), F.expr("d.source <=> s.source")).select(
        "_row", _copies(rank).cast("int").alias("_copies")).where("_copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).select("_row.*")
