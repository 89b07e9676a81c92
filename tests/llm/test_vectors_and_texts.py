"""Searches, near-duplicates, encoding and the pipeline against brute force."""

import collections
import hashlib

import cases
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import bpe, chunks, near_dup, permutation_index, segment_search, vectors
from gradeframe.llm.graph import components
from gradeframe.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, rank int, score double"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], VECTORS).repartition(3)


def odd_vectors(n=300, width=6, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # many copies, all ties
    rows += [(2000, None), (2001, [0.0] * width), (2002, [1.0, None] + [0.0] * (width - 2)),
             (2003, [float("nan")] * width), (2004, [float("inf")] + [0.0] * (width - 1)), (None, [1.0] * width),
             (2005, [1.0, 2.0]), (2006, []), (20, rows[20][1]), (2020, [float(np.float32(1e-30))] * width)]
    return rows


def brute(rows, chosen, k, value):
    out = {}
    for q, a in rows:
        if chosen(q):
            scored = sorted(((-value(a, b), i) for i, b in rows if i != q))[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def collected(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return out


def distinct(rows, keep):
    return list({(i, tuple(v)): (i, v) for i, v in rows if i is not None and keep(v)}.values())


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


@pytest.mark.parametrize("shard_rows", [16384, 70])
def test_segment_search_is_exact(spark, shard_rows):
    rows = odd_vectors()
    got = collected(segment_search.search_integers(table_of(spark, rows), F.col("vec_id") % 5 == 0, 5, shard_rows, 40))
    whole = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    used = [(i, whole(v)) for i, v in distinct(rows, finite)]
    assert got == brute(used, lambda q: q % 5 == 0, 5, lambda a, b: sum(x * y for x, y in zip(a, b)))


def test_segment_bounds_hold():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(50, 37)), rng.normal(size=37)
    for segments in segment_search.LEVELS:
        (m, d, length), (mq, dq, _) = segment_search.statistics(x, segments), segment_search.statistics(q[None], segments)
        least = length * ((m - mq) ** 2 + (d - dq) ** 2).sum(1)
        assert (least <= ((x - q) ** 2).sum(1) + 1e-9).all()


def test_very_large_components_are_exact():
    big = np.floor(256 * np.array([[3e12, -1.0], [3e12, 2.0], [1.0, 1.0]]))
    found = segment_search.top_integers(np.array([0]), big[:1], np.array([0, 1, 2]), big, 2)
    assert found[2].tolist()[0] == (1 << 63) - 1 and found[1].tolist() == [1, 2]


@pytest.mark.parametrize("candidates", [1.0, 0.2])
def test_permutation_index(spark, candidates):
    rows = odd_vectors(n=600)
    df = table_of(spark, rows)
    got = collected(permutation_index.nearest(df, F.col("vec_id") % 20 == 0, 20, pivots=32, depth=12,
                                              candidates=candidates, least=60, shard_rows=256, block_rows=20))
    used = distinct(rows, lambda v: finite(v) and any(v))
    want = brute(used, lambda q: q % 20 == 0, 20, dot)
    assert got.keys() == want.keys()
    if candidates == 1:
        assert got == want
    hits = [len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    vectors_of = dict(used)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == dot(vectors_of[q], vectors_of[i]) for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)


def test_permutation_index_recall_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    data = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    used = [(r["vec_id"], r["embedding"]) for r in data]
    got = collected(permutation_index.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"),
                                              F.col("vec_id") % 20 == 0, least=125))
    want = brute(used, lambda q: q % 20 == 0, 20, dot)
    assert np.mean([len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_permutation_index_recall_on_unequal_lengths(spark):
    """Production parameters on a full shard; the longest vectors are the answers, at wider angles."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(permutation_index.SHARD_ROWS, 64))
    x *= np.exp(0.5 * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = collected(permutation_index.nearest(df, F.col("vec_id") % 256 == 0))
    score = x[list(got)] @ x.T
    score[np.arange(len(got)), list(got)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert len(got) == 64
    assert np.mean([len({i for _, i, _ in f} & set(w)) / 20 for f, w in zip(got.values(), want.tolist())]) >= 0.95


@pytest.mark.parametrize("n", [600, 3000, 40000])
def test_permutation_index_recall_at_any_size(spark, n):
    """Production parameters, from a part of a shard to several, all through the inverted files."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)) + 2 * rng.normal(size=(40, 64))[rng.integers(0, 40, n)]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": list(x)}))
    got = collected(permutation_index.nearest(df, F.col("vec_id") % (n // 60) == 0))
    score = x[list(got)] @ x.T
    score[np.arange(len(got)), list(got)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len({i for _, i, _ in f} & set(w)) / 20 for f, w in zip(got.values(), want.tolist())]) >= 0.9


def test_searches_of_empty_tables(spark):
    empty = table_of(spark, odd_vectors()).limit(0)
    assert permutation_index.nearest(empty, F.lit(True)).count() == 0
    assert segment_search.search_integers(empty, F.lit(True)).count() == 0
    one = table_of(spark, [(1, [1.0, 2.0])])
    assert permutation_index.nearest(one, F.lit(True)).count() == 0
    assert vectors.SHARD_ROWS > 0


# Near-duplicates

def jaccard_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = cases.words(t)
        sets[i] = ({tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size
                   else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, base, share):
    return " ".join(f"x{rng.integers(10**6)}" if rng.random() < share else w for w in base)


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = np.random.default_rng(size)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    texts = [(i, edited(rng, base, rng.choice([0.0, 0.01, 0.03, 0.06]))) for i in range(90)]
    texts += [(100 + i, " ".join(base[:60]) + " " + " ".join(f"y{rng.integers(9999)}" for _ in range(40))) for i in range(20)]
    texts += [(200 + i, " ".join(f"z{rng.integers(500)}" for _ in range(rng.integers(1, 60)))) for i in range(40)]
    texts += [(300, ""), (301, None), (302, "one"), (303, "ONE"), (304, "a b"), (305, "A\tb\n"), (306, cases.LONG), (307, cases.LONG)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, component_id int, key string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, size).collect()}
    assert got == jaccard_components(texts, size, 80)


def test_only_strays_of_a_large_bucket_are_copied(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 100)
    rows = [(1, 0, i, 7 if i < 5000 else i, b"") for i in range(5003)] + [(2, 0, i, i % 2, b"") for i in range(10)]
    dealt = near_dup._blocks(spark.createDataFrame(rows, "bucket long, band int, rep long, component long, signature binary"))
    assert dealt.where("bucket = 1").count() == 5000 + 3 * 51
    groups = collections.defaultdict(lambda: collections.defaultdict(set))
    for r in dealt.collect():
        groups[r["bucket"], r["i"], r["j"]][r["own"]].add((r["rep"], r["component"]))
    met = collections.Counter()
    for (bucket, i, j), blocks in groups.items():
        for a, x in blocks[i]:
            for b, y in blocks[j]:
                if x != y and (i != j or a < b):
                    met[bucket, min(a, b), max(a, b)] += 1
    assert set(met.values()) == {1} and len(met) == 3 * 5000 + 3 + 25


def test_near_duplicates_take_odd_rows(spark):
    docs = cases.documents(spark)
    got = near_dup.near_duplicates(docs, 2)
    rows = collections.defaultdict(set)
    for r in got.collect():
        rows[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got.count() == docs.count()
    assert rows[1] == {(1, True)} and rows[2] == {(1, False)} and rows[None] == {(None, True)}
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(9)
    least = near_dup.least_matches(0.8, near_dup.MISS)
    match = rng.random((20000, near_dup.HASHES)) < 0.8
    a = np.zeros(match.shape, np.uint16)
    assert len(near_dup._stay(a, (~match).astype(np.uint16), least)) >= 19990
    far = rng.random((2000, near_dup.HASHES)) < 0.4
    assert len(near_dup._stay(a[:2000], (~far).astype(np.uint16), least)) == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(links, "u long, v long"))
    assert {(r["node"], r["component"]) for r in got.collect()} == {
        (i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)}


# Encoding

@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@pytest.mark.parametrize("chunk_bytes", [1 << 24, 4096])
def test_ids_are_those_of_the_library(spark, vocabulary, chunk_bytes):
    import tiktoken
    ranks, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    more = [(50 + i, t, None, None, None) for i, t in enumerate(
        ["  two  blanks \n\n\t end  ", "it's we'LL 'll", "日本語 и русский", "  x", "a\u0000b", "!!'s ??", "🙂🙂", "1234567 x2"])]
    docs = cases.documents(spark).unionByName(cases.documents(spark, more))
    got = bpe.encode(docs, ranks, pattern, chunk_bytes)
    done = got.select("doc_id", "ids", bpe.decode(F.col("ids"), ranks).alias("b")).collect()
    want = sorted((repr(r["doc_id"]), library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode())
                  for r in docs.select("doc_id", "text").collect())
    assert sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["b"])) for r in done) == want
    assert bpe.encode(docs.limit(0), ranks, pattern).count() == 0
    both = bpe.encode(docs, ranks, pattern, chunk_bytes, bucket_bytes=8192, decoded=True).collect()
    assert sorted((repr(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in both) == want


def test_words_are_sent_in_proportion(spark, vocabulary):
    """Half as large chunks send about twice as many rows, since buckets depend on the texts alone."""
    ranks, pattern = vocabulary
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def rows(chunk_bytes):
        n, buckets = chunks.chunk_and_bucket_counts(docs, chunk_bytes, 1 << 19)
        return bpe._sent(chunks.packed(docs, n), pattern, buckets).count()

    few, many = rows(1 << 17), rows(1 << 16)
    assert many <= 2.2 * few


# The pipeline

def test_pipeline_stage_by_stage(spark, vocabulary, tmp_path):
    folder = "/root/testdata/sf0.01"
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "encode"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS) and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    quality, kept, clean, mixed, encoded = seen
    texts = [(r["doc_id"], r["text"]) for r in quality.select("doc_id", "text").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    passed = {i for i, _ in texts}
    assert np.mean([(i in passed) == (q == 1) for i, q in labels.items()]) > 0.95
    want = {i for i, (_, c) in jaccard_components(texts, 5, 80).items() if c == i}
    assert {r["doc_id"] for r in kept.collect()} == want
    from test_native import base_spans
    before = {r["doc_id"]: r["text"] for r in kept.collect()}
    for r in clean.collect():
        assert base_spans(r["text"]) == "" and (base_spans(before[r["doc_id"]]) != "") == ("[secret]" in r["text"])
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[r["doc_id"]]
    taken = collections.Counter(r["doc_id"] for r in mixed.collect())
    total = sum(len(cases.words(r["text"])) for r in clean.collect())
    words = sum(len(cases.words(r["text"])) for r in mixed.collect())
    assert max(taken.values()) <= 2 and abs(words - 1.5 * total) < 0.05 * total
    digest = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in mixed.collect()}
    rows = encoded.collect()
    assert len(rows) == mixed.count() and all(r["decoded_sha256"] == digest[r["doc_id"]] for r in rows)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    docs = cases.documents(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(
        map(repr, [1, 3, 4, None, None, 5, 6, 7, 8, 9, 10]))
    again = corpus_pipeline.near_duplicates(spark, docs.where("doc_id = 2"), str(tmp_path))
    assert [r["doc_id"] for r in again.collect()] == [2]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
