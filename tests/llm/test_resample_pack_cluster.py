"""Importance resampling, packing and centroid clustering against plain versions."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import cases
import compare
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeframe.llm import importance, packing, vantage
from gradeframe.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_vantage_clusters"])
def test_query_equals_sql(spark, name):
    assert compare.rows_of_query(QUERIES[name](spark, FOLDER)) == compare.rows_of_sql(ORACLES[name], FOLDER)


# Importance resampling

def test_hash_is_xxh64():
    rng = np.random.default_rng(1)
    for size in [*range(1, 80), 500, 4097]:
        rows = rng.integers(0, 256, (5, size), dtype=np.uint8)
        assert importance.xxh64(rows).tolist() == [xxhash.xxh64_intdigest(r.tobytes()) for r in rows]


def grams(text, longest):
    found = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return [b" ".join(found[i:i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


ODD = ["The cat, the CAT!  the-cat", "", None, "É é naïve 🙂🙂 x", "a b a b a", "w" * 5000 + " " + "w" * 5000, "\x00\t12 34 12", "...", "the cat"]


@pytest.mark.parametrize("longest", [1, 3])
def test_interned_grams(longest):
    for words in importance.slices(pa.array(ODD), True, importance._BREAK):
        seen = importance.Interned(words, longest, 97)
        want = [grams(t, longest) for t in ODD]
        counts = collections.Counter(g for g_ in want for g in g_)
        assert sorted(seen.count[seen.count > 0].tolist()) == sorted(counts.values())
        raw = seen.data.tobytes()
        for start, size, doc, slot in zip(seen.start, seen.size, seen.doc, seen.slot):
            gram = raw[start:start + size]
            assert gram in want[doc]
            assert seen.bucket[slot] == zlib.crc32(gram) % 97 and seen.count[slot] == counts[gram]


def test_bytes_decide_when_keys_agree(monkeypatch):
    monkeypatch.setattr(importance.Interned, "_keys", lambda self: np.full(len(self.size), 7, np.uint64))
    test_interned_grams(2)


def resampled(rows, target, longest, percent, min_words, buckets=50, seed=2024):
    bucket = lambda g: zlib.crc32(g) % buckets
    s = collections.Counter(bucket(g) for _, t in rows for g in grams(t, longest))
    t_ = collections.Counter(bucket(g) for t in target for g in grams(t, longest))
    all_s, all_t = sum(s.values()), sum(t_.values())
    out = []
    for doc_id, text in rows:
        own = grams(text, longest)
        weight = sum(math.floor(1000 * math.log((t_[bucket(g)] + 1) * (all_s + buckets) / ((s[bucket(g)] + 1) * (all_t + buckets))))
                     for g in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(grams(text, 1)), len(own), weight, score])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[:percent * len(able) // 100]
    return sorted(map(repr, (tuple(r) for r in out))), [(r[0], r[4]) for r in drawn]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_of_odd_documents(spark, longest):
    docs = cases.documents(spark).unionByName(cases.documents(spark, [
        (100 + i // 3, f"word{i} the fox {i % 5} jumps", "en", "a", 9) for i in range(60)]))
    target = spark.createDataFrame([("the fox jumps",), (None,), ("the dog",)], "text string")
    got = importance.resample(docs, target, 30, 3, longest, buckets=50, keep=("source",)).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    every, drawn = resampled(rows, [r["text"] for r in target.collect()], longest, 30, 3)
    assert sorted(repr((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in got) == every
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == drawn


def test_ranks_over_many_ranges_and_one_hot_id(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("doc_id"),
        F.lit(30).cast("long").alias("n_words"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).cast("long").alias("score"))
    got = importance.draw(rows.repartition(13), 50).collect()
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert len(got) == 6000 and [r["rank"] for r in ranked] == list(range(1, 3001))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys)
    assert keys == sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got)[:3000]


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    row = importance.resample(some, none, 100, 1).collect()[0]
    assert row["rank"] == 1 and row["n_features"] == 3


# Packing

def least_sequences(counts, capacity):
    """The optimum by search over what goes with the largest piece."""
    @functools.cache
    def least(left):
        sizes = [s for s, n in enumerate(left) if n]
        if not sizes:
            return 0
        best = math.inf
        rest = list(left)
        rest[sizes[-1]] -= 1

        def beside(room, top, counts_):
            nonlocal best
            best = min(best, 1 + least(tuple(counts_)))
            for s in range(min(room, top), 0, -1):
                if counts_[s]:
                    counts_[s] -= 1
                    beside(room - s, s, counts_)
                    counts_[s] += 1

        beside(capacity - sizes[-1], capacity, rest)
        return best

    return least(tuple(counts))


def test_dominance_keeps_the_optimum():
    rng = random.Random(5)
    fixed = 0
    for _ in range(250):
        capacity = rng.randint(5, 14)
        counts = np.zeros(capacity + 1, np.int64)
        for _ in range(rng.randint(1, 8)):
            counts[rng.randint(rng.choice([1, capacity // 4 + 1]), capacity)] += 1
        plan, rest = packing.Plan(capacity), counts.copy()
        packing.reduce(rest, plan)
        fixed += plan.fixed
        assert plan.fixed + least_sequences(rest.tolist(), capacity) == least_sequences(counts.tolist(), capacity)
    assert fixed > 250


@pytest.mark.parametrize("seed", range(8))
def test_plans_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 64, 1024]))
    counts = np.zeros(capacity + 1, np.int64)
    for length in rng.integers(1, capacity + 1, 60):
        counts[length] += int(rng.choice([1, 2, 50, 10 ** 9]))
    plan = packing.plan_lengths(counts, capacity)
    held = np.zeros_like(counts)
    for copies, lengths in plan.groups:
        assert copies > 0 and sum(n * k for n, k in lengths) <= capacity
        for n, k in lengths:
            held[n] += copies * k
    assert (held == counts).all() and len(plan.groups) <= 4 * capacity
    assert plan.sequences <= packing.plan_lengths(counts, capacity, dominance=False).sequences
    assert plan.sequences >= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)


@pytest.fixture(scope="module")
def encode():
    return packing.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(spark, encode, library):
    rng = random.Random(3)
    letters = "aé字🙂 \n\t '1٣.,<|>st\x00‍"
    texts = [r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["<|endoftext|> is text", "", " " * 30001 + "x", "\n" * 20000, cases.LONG, "a" * 20000]
    for text in texts:
        assert encode(text).tolist() == library(text), text[:50]


def test_packing_of_odd_documents(spark, encode, library):
    docs = cases.documents(spark)
    got = packing.pack(docs, encode, end=2, capacity=64).collect()
    whole, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        whole[r["doc_id"], r["start"] == 0 or r["piece"] > 0].append(r)
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in of_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    want = collections.Counter()
    for r in docs.collect():
        ids = [*library(r["text"] or ""), 2]
        first = (len(ids) - 1) % 64 + 1
        for k, at in enumerate([0, *range(first, len(ids), 64)]):
            want[r["doc_id"], k, at, tuple(ids[at:at + (first if k == 0 else 64)])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in got) == want
    filled = packing.sequences(packing.pack(docs, encode, end=2, capacity=64)).collect()
    assert sum(len(r["ids"]) for r in filled) == sum(len(k[3]) * n for k, n in want.items())
    assert all(len(r["ids"]) == sum(r["lengths"]) <= 64 for r in filled)
    assert packing.pack(docs.limit(0), encode, end=2).collect() == []


def test_packing_query(spark, library):
    rows = QUERIES["op12_best_fit_packing"](spark, FOLDER).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    of_doc = collections.defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
    assert of_doc.keys() == texts.keys()
    for doc_id, pieces in of_doc.items():
        ids, at = [*library(texts[doc_id] or ""), 2], 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            part = np.array(ids[at:at + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    tokens = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * -(-tokens // 1024) + 1


# Clustering

def nearest(x, points):
    away = ((x[:, None, :] - points[None]) ** 2).sum(2)
    return away.argmin(1), away.min(1)


@pytest.mark.parametrize("leaf", [1, 2, 5])
@pytest.mark.parametrize("spread", [2, 40, 1 << 27])
def test_tree_finds_the_smallest_nearest(leaf, spread):
    rng = np.random.default_rng(spread + leaf)
    for k in (1, 2, 3, 8, 40):
        points = rng.integers(-spread, spread, (k, 5))
        points[k // 2] = points[0]  # equal centroids: the smaller number wins
        x = np.concatenate([rng.integers(-spread, spread, (300, 5)), points])
        number, away = vantage.assign(x, vantage.build(points, leaf))
        want = nearest(x, points)
        assert number.tolist() == want[0].tolist() and away.tolist() == want[1].tolist()


def test_tree_leaves_subtrees_out(monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.integers(-1000, 1000, (64, 3))
    x = points.repeat(20, 0) + rng.integers(-3, 3, (1280, 3))
    seen, plain = [], vantage._squares
    tree = vantage.build(points)
    monkeypatch.setattr(vantage, "_squares", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    number, _ = vantage.assign(x, tree)
    assert number.tolist() == nearest(x, points)[0].tolist()
    assert sum(seen) < 0.5 * len(x) * len(points)


def clustered(rows, k, scale, rounds, seed):
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] for _, v in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(
        f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    points = x[order[:k]]
    for _ in range(rounds):
        number, _ = nearest(x, points)
        points = np.array([[int(s) // int((number == c).sum()) for s in x[number == c].sum(0)] if (number == c).any()
                           else points[c].tolist() for c in range(len(points))])
    number, away = nearest(x, points)
    sums = [int(away[number == c].sum()) for c in range(len(points))]
    return collections.Counter((rows[i][0], int(number[i]), int(away[i]), sums[number[i]], sum(sums), hashlib.sha256(
        ",".join(map(str, points[number[i]])).encode()).hexdigest()) for i in range(len(rows)))


@pytest.mark.parametrize("k", [1, 5, 500])
def test_clusters_of_odd_vectors(spark, k):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(200)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(20, rows[20][1])] * 2 + [(None, [0.5] * 6), (7, [0.0] * 6)]
    odd = [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None] + [0.0] * 4), (904, [float("nan")] * 6),
           (905, [float("inf")] + [0.0] * 5), (906, [3e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows + odd],
                               "vec_id long, embedding array<float>, cluster int, distance double").repartition(4)
    assigned, points = vantage.cluster(df, k=k, width=6, scale=1024, rounds=3, seed=3)
    got = collections.Counter(tuple(r) for r in vantage.described(assigned, points).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())
    assert got == clustered(rows, k, 1024, 3, 3)


def test_clusters_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assigned, points = vantage.cluster(df)
    assert len(points) == 0 and vantage.described(assigned, points).collect() == []
