"""Quality, language and language-model scores: held-out figures and plain Python versions."""

import collections
import itertools
import math
import zlib

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import common, language_crf, pitman_yor, quality_gam
from gradeframe.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"  # the smaller tables have too few labels
    got = QUERIES["op4_quality_gam"](spark, folder).toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 10000 and len(both) > 500
    assert (both.predicted == both.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())


def test_quality_score_is_a_sum_of_table_entries(spark):
    rng = np.random.default_rng(1)
    x = rng.random((800, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    model = quality_gam.fit(x, y)
    assert any({i, j} == {0, 1} for i, j, _ in model.pairs)
    for row, p in zip(x[:50], model.probability(x[:50])):
        b = [int(np.searchsorted(e, v, side="right")) for e, v in zip(model.edges, row)]
        total = model.intercept + sum(t[k] for t, k in zip(model.tables, b)) + sum(
            t[b[i], b[j]] for i, j, t in model.pairs)
        assert p == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.95


def test_quality_takes_odd_rows(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame([(1, 1, None, "x"), (2, 0, 1, "x"), (5, None, 0, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    for some in (labels, labels.limit(0)):
        model = quality_gam.train(docs, some)
        got = docs.withColumn("p", quality_gam.score(F.col("text"), model))
        assert got.count() == docs.count() and all(0 < r["p"] < 1 for r in got.collect())
    assert docs.limit(0).withColumn("p", quality_gam.score(F.col("text"), model)).count() == 0


@pytest.fixture(scope="module")
def chain(spark):
    return language_crf.train(common.table(spark, FOLDER, "documents"), epochs=20)


def test_rare_languages_are_learned_and_repeated_ids_count_once(spark):
    docs = spark.range(4000).select(
        "id", F.when(F.col("id") < 20, "xx").otherwise("yy").alias("lang"),
        F.when(F.col("id") < 20, "zorgu blipta quonx").otherwise("the plain words").alias("text"))
    docs = docs.select(F.col("id").alias("doc_id"), "lang", "text").unionByName(
        spark.range(2000).select(F.lit(9000).cast("long").alias("doc_id"), F.lit("yy").alias("lang"),
                                 F.lit("again again").alias("text")))
    model = language_crf.train(docs, max_documents=60, least=10, epochs=10)
    assert set(model.labels) == {"xx", "yy"}
    got = docs.groupBy("lang").agg(F.count_if(
        language_crf.identify(F.col("text"), model)["lang_pred"] == F.col("lang")).alias("n")).collect()
    assert {r["lang"]: r["n"] for r in got if r["lang"] == "xx"} == {"xx": 20}


def test_language_on_held_out_documents(spark, chain):
    docs = common.table(spark, FOLDER, "documents")
    got = docs.where(common.held_out(F.col("doc_id"), 0)).select(
        "lang", language_crf.identify(F.col("text"), chain).alias("f")).collect()
    assert sum(r["lang"] == r["f"]["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["f"]["score"] <= 1 for r in got)


def test_words_of_a_switched_text(spark, chain):
    row = spark.createDataFrame([("the thing of that 12 einschaft und die keitung",)], "text string").select(
        language_crf.label_words(F.col("text"), chain).alias("w")).first()
    assert [w["lang"] for w in row["w"]] == ["en"] * 4 + ["de"] * 4


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    lengths, n = [3, 0, 1, 4], 3
    first = np.concatenate([[0], np.cumsum(lengths)])
    emissions, moves = rng.normal(size=(first[-1], n)), rng.normal(size=(n, n))
    got = language_crf.posteriors(emissions, first, moves)
    for a, b in zip(first[:-1], first[1:]):
        want = np.zeros((b - a, n))
        for path in np.ndindex(*[n] * (b - a)):
            s = sum(emissions[a + t, k] for t, k in enumerate(path)) + sum(
                moves[i, j] for i, j in zip(path, path[1:]))
            for t, k in enumerate(path):
                want[t, k] += math.exp(s)
        assert np.allclose(got[a:b], want / np.maximum(want.sum(1, keepdims=True), 1e-300))


def test_language_takes_odd_rows(spark, chain):
    docs = cases.documents(spark)
    got = docs.select("doc_id", "text", language_crf.identify(F.col("text"), chain).alias("f")).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["f"]["lang_pred"] == "und") == (not letters) and (r["f"]["score"] > 0) == letters
    empty = language_crf.train(docs.limit(0))
    assert empty.labels == []
    assert {r["f"]["lang_pred"] for r in docs.select(language_crf.identify(F.col("text"), empty).alias("f")).collect()} == {"und"}


def _counts(docs):
    seen, tokens = collections.Counter(), []
    for r in docs:
        held = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1
        tokens.append((r["doc_id"], held, [*cases.words(r["text"]), b""]))
        if not held:
            seen.update(tokens[-1][2])
    return seen, tokens


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 1 << 16])
def test_language_model_counts_and_base(spark, chunk_bytes):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(
        cases.documents(spark).select("doc_id", "text")).repartition(4)
    got = pitman_yor.score(docs, common.held_out(F.col("doc_id"), 1), chunk_bytes=chunk_bytes).collect()
    seen, tokens = _counts(docs.collect())
    total, size = sum(seen.values()), len(seen)
    want = sorted((repr(d), h, len(t), sum(w in seen for w in t), total,
                   round(sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (size + 1))) for w in t), 6)) for d, h, t in tokens)
    have = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in got)
    assert have == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(5)
    words, discount = 30, 0.6
    pairs = np.unique(rng.integers(0, words, 200) * pitman_yor.CONTEXTS + rng.choice([0, 1, 17, 1023], 200))
    known, word = np.unique(pairs // pitman_yor.CONTEXTS, return_inverse=True)
    seating = pitman_yor.Seating(word * pitman_yor.CONTEXTS + pairs % pitman_yor.CONTEXTS,
                                 rng.integers(1, 300, len(pairs)), len(known))
    stirling = pitman_yor.log_stirling(discount)
    for _ in range(2):
        seating.sweep(pitman_yor.Totals(seating.totals(), discount), stirling, rng)
        totals = pitman_yor.Totals(seating.totals(), discount)
        assert (seating.t2 >= 1).all() and (seating.t2 <= seating.n2).all() and (seating.t0 <= seating.n0).all()
        for leaf in (0, 1, 17, 500):
            ids = np.array([*range(len(known)), -1])
            assert seating.predictive(totals, ids, np.full(len(ids), leaf)).sum() == pytest.approx(1.0)


def test_language_model_over_whole_words_is_a_distribution():
    rng = np.random.default_rng(6)
    words, contexts, discount = 20, 40, 0.7
    pairs = np.unique(rng.integers(0, words * contexts, 300))
    known, word = np.unique(pairs // contexts, return_inverse=True)
    seating = pitman_yor.WordSeating(word, pairs % contexts, rng.integers(1, 200, len(pairs)),
                                     rng.choice([0, 1, 17, 1023], contexts), len(known))
    customers = np.bincount(seating.at, seating.n3, contexts)
    stirling = pitman_yor.log_stirling(discount), pitman_yor.log_stirling(0.4)
    for _ in range(2):
        seating.sweep(pitman_yor.Totals(seating.base.totals(), 0.4), seating.tables(), discount, *stirling, rng)
        totals = pitman_yor.Totals(seating.base.totals(), 0.4)
        assert (seating.t3 >= 1).all() and (seating.t3 <= seating.n3).all()
        assert seating.base.n2.sum() == seating.t3.sum()
        for at in range(contexts):
            ids = np.array([*range(len(known)), -1])
            place = [next(iter(np.flatnonzero((seating.word == w) & (seating.at == at))), -1) for w in ids]
            assert seating.predictive(totals, customers, seating.tables(), discount, ids, np.full(len(ids), at),
                                      np.array(place)).sum() == pytest.approx(1.0)


def test_a_stored_seating_goes_on_as_if_never_stored():
    words, contexts, discount = 20, 40, 0.7
    stirling = pitman_yor.log_stirling(discount), pitman_yor.log_stirling(0.4)

    def begin():
        rng = np.random.default_rng(6)
        pairs = np.unique(rng.integers(0, words * contexts, 300))
        known, word = np.unique(pairs // contexts, return_inverse=True)
        return pitman_yor.WordSeating(word, pairs % contexts, rng.integers(1, 200, len(pairs)),
                                      rng.choice([0, 1, 17, 1023], contexts), len(known))

    def sweep(seating, k):
        seating.sweep(pitman_yor.Totals(seating.base.totals(), 0.4), seating.tables(), discount, *stirling,
                      np.random.default_rng(k))

    through, state = begin(), None
    for k in range(4):
        sweep(through, k)
        again = begin()
        if state is not None:
            again.restore(pitman_yor._unpack_counts(state))
        sweep(again, k)
        state = pitman_yor._pack_counts(again.state())
        assert (again.state() == through.state()).all() and (again.base.totals() == through.base.totals()).all()
        assert (again.tables() == through.tables()).all()


def test_contexts_are_whole_words(spark):
    """Words that end alike, and whose endings share a hash, predict what follows each of them."""
    rows = [(i, f"xx{i % 40:02d}ab yy{i % 40}q") for i in range(800)]
    rows += [(1000 + i, f"xx{i:02d}ab yy{i}q") for i in range(40)] + [(2000 + i, f"xx{i:02d}ab yy{(i + 1) % 40}q") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk_bytes in (1 << 24, 1 << 10):
        got = {r["doc_id"]: r["score"] for r in pitman_yor.score(docs, F.col("doc_id") >= 1000, chunk_bytes=chunk_bytes).collect()}
        assert all(got[1000 + i] > got[2000 + i] + 1 for i in range(40))


def test_tables_are_drawn_from_their_conditional():
    discount, n, a = 0.5, 6, 1.7
    stirling = pitman_yor.log_stirling(discount)
    got = pitman_yor.draw_tables(np.full(40000, n), np.full(40000, a), discount, stirling, np.random.default_rng(2))
    weights = np.array([math.exp(stirling[n, t]) * a ** t for t in range(1, n + 1)])
    assert np.allclose(np.bincount(got, minlength=n + 1)[1:] / 40000, weights / weights.sum(), atol=0.01)
    # The Stirling numbers are sums over all seatings of three customers.
    assert math.exp(stirling[3, 1]) == pytest.approx((1 - discount) * (2 - discount))
    assert math.exp(stirling[3, 2]) == pytest.approx(3 * (1 - discount))


@pytest.mark.parametrize("discount", [0.3, 0.8])
def test_tables_of_many_customers_follow_the_conditional(discount):
    exact, short = pitman_yor.log_stirling(discount, 700), pitman_yor.log_stirling(discount)
    t = np.arange(1, 701)
    for n, a in itertools.product((65, 200, 700), (0.01, 1.0, 10.0, 80.0)):
        logits = exact[n, 1:] + t * np.log(a)
        weights = np.exp(logits - logits.max())
        weights /= weights.sum()
        mean = (weights * t).sum()
        got = pitman_yor.draw_tables(np.full(20000, n), np.full(20000, a), discount, short, np.random.default_rng(3))
        assert got.min() >= 1 and got.max() <= n
        assert got.mean() == pytest.approx(mean, rel=0.03)
        assert got.std() == pytest.approx(((weights * t * t).sum() - mean ** 2) ** 0.5, rel=0.3, abs=0.02)
    got = pitman_yor.draw_tables(np.full(20000, 10 ** 9), np.full(20000, 6.0), discount, short, np.random.default_rng(4))
    assert got.mean() == pytest.approx(1 + 6 / discount, rel=0.02)


def test_language_model_without_training_or_documents(spark):
    docs = cases.documents(spark)
    got = pitman_yor.score(docs, F.lit(True)).collect()
    assert len(got) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert pitman_yor.score(docs.limit(0), F.lit(False)).count() == 0


def test_totals_beyond_32_bits():
    for counts in ([[1, 2], [3, 4]], [[1, 5_000_000_000]], [[]]):
        counts = np.array(counts, np.int64)
        assert pitman_yor._unpack_counts(pitman_yor._pack_counts(counts)).tolist() == counts.ravel().tolist()
