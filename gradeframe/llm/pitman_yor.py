"""Scoring texts by a hierarchical Pitman-Yor language model.

A token's context is the whole word before it. Each context is a restaurant;
restaurants of words that end alike share a parent by their last two bytes,
those with the same last byte share another, and these share the root, whose
base is uniform over the known words and one more. Tables are sampled by Gibbs
sweeps, each restaurant and word given its parent, and the predictive
probabilities of several sweeps are averaged.

Words are dealt to buckets by hash, with all that the restaurants know of them,
so a sweep needs of other buckets only the totals of each restaurant. Those of
whole words, which grow with the corpus, are summed after every sweep in parts
dealt by the context's hash, and each bucket hears of the contexts that it meets.
Those of word endings, ``2 * (CONTEXTS + PARENTS) + 9`` numbers, go through the
driver. Each sweep is written with its seating, which the next one goes on from.
Counts are gathered from all training documents.
"""

from __future__ import annotations

import itertools
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.chunks import (
    chunk_count, pack_array, pack_words, packed, unpack_array, unpack_words, unpacked,
)
from gradeframe.llm.common import stored

PARENTS = 64
PER_PARENT = 16
CONTEXTS = PARENTS * PER_PARENT
END = b""  # no word is empty
STRENGTH = 1.0
EXACT = 64  # customers up to which tables are drawn from their exact conditional
CHUNK_BYTES = 16 << 20  # as many chunks as buckets, so smaller ones would cost rows
_SENT = "bucket int, chunk long, n int, words binary, sizes binary, contexts binary, places binary, counts binary"
_MERGED = ("bucket int, chunk long, n int, sizes binary, contexts binary, ends binary, edges binary, places binary, "
           "counts binary")
_DEALT = "part int, bucket int, sums binary"
_TOTALS, _STATE = -1, -2  # in place of a part: a bucket's sums for the driver, and its seating


# By the last byte and 256 times the one before.
_ENDINGS = np.array([(last * 37 % 251 % PARENTS) * PER_PARENT + before * 29 % 251 % PER_PARENT
                     for before in range(256) for last in range(256)])


def context(word: bytes) -> int:
    """Ending of a word, the parent of its own context: of its last two bytes, grouped by the last.

    ``END`` stands for the beginning of a text.
    """
    return int(_ENDINGS[_last_two(word)])


def context_keys(words: list[bytes]) -> np.ndarray:
    """The contexts that whole words are: 53 bits of a word's hash, then its ending."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(11)
    return hashes.astype(np.int64) * CONTEXTS + _ENDINGS[np.fromiter(map(_last_two, words), np.int64, len(words))]


def _last_two(word: bytes) -> int:
    return int.from_bytes(word[-2:], "big")


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: row n, column t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(most):
        t = np.arange(most + 1)
        stay = n - discount * t
        with np.errstate(divide="ignore", invalid="ignore"):
            same = np.where(stay > 0, out[n] + np.log(np.where(stay > 0, stay, 1)), -np.inf)
        out[n + 1] = np.logaddexp(same, np.concatenate([[-np.inf], out[n, :-1]]))
    return out


def draw_tables(n: np.ndarray, a: np.ndarray, discount: float, stirling: np.ndarray, rng) -> np.ndarray:
    """Tables of n customers of one word given the weight a of opening one.

    Up to ``EXACT`` customers the number is drawn from its exact conditional,
    Stirling number times a power of a. From there it is led to n customers in
    blocks that grow with the customers seated. The exact mean grows with each
    customer by (a - discount * variance) / (n + a - discount * mean): tables
    open at the rate of the first term and all but one close at that of the
    second. This ends, for many customers, in the exact limit, one more than a
    Poisson number of mean a / discount. On the way means are within 3 % of the exact
    ones and deviations within 30 %.
    """
    t = np.ones(len(n), np.int64)
    few = np.minimum(n, EXACT)
    for low, width in ((2, 8), (9, EXACT)):
        rows = np.flatnonzero((few >= low) & (few <= width))
        for at in range(0, len(rows), 20000):
            part = rows[at:at + 20000]
            logits = stirling[few[part], 1:width + 1] + np.arange(1, width + 1) * np.log(a[part])[:, None]
            weights = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (weights < (rng.random(len(part)) * weights[:, -1])[:, None]).sum(1)
    rows = np.flatnonzero(n > EXACT)
    seated = np.full(len(rows), EXACT)
    while len(rows):
        block = np.minimum(seated // 8, n[rows] - seated)
        middle, weight = seated + block / 2, a[rows]
        time = block / (middle + weight - discount * t[rows])
        close = discount * spread_over_mean(middle, weight, discount)
        stay = rng.binomial(t[rows] - 1, np.exp(-close * time))
        seated = seated + block
        t[rows] = np.minimum(1 + stay + rng.poisson(-weight * np.expm1(-close * time) / close), seated)
        more = seated < n[rows]
        rows, seated = rows[more], seated[more]
    return t


def spread_over_mean(n: np.ndarray, a: np.ndarray, discount: float) -> np.ndarray:
    """Variance over mean of the number of tables of n customers, by saddle point.

    ``(1 - (1 - x) ** discount) / discount`` generates the tables; where x times
    its slope is n / a lies the saddle, found by Newton's method on log(1 - x)
    from its upper side.
    """
    u = np.log(a / (a + n))
    for _ in range(6):
        y = np.exp(u)
        u = u + (np.log1p(-y) - (1 - discount) * u - np.log(n / a)) / (y / (1 - y) + 1 - discount)
    y = np.exp(u)
    mean = a * -np.expm1(discount * u) / discount
    return np.clip(1 - n * y / (1 - discount + discount * y) / mean, 0.01, 1.0)


class Seating:
    """The restaurants' customers and tables of one bucket's words."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, words: int):
        self.word, self.leaf, self.n2 = pairs // CONTEXTS, pairs % CONTEXTS, counts
        key = self.word * PARENTS + self.leaf // PER_PARENT
        mid, self.up = np.unique(key, return_inverse=True)
        self.mid_word, self.mid = mid // PARENTS, mid % PARENTS
        self.words = words
        self.t2 = np.ones(len(pairs), np.int64)
        self.settle()
        self.t1, self.t0 = np.ones(len(mid), np.int64), np.ones(words, np.int64)
        self.settle()

    def settle(self):
        """Each table sends a customer to the parent."""
        self.n1 = np.bincount(self.up, self.t2, len(self.mid)).astype(np.int64)
        if hasattr(self, "t1"):
            self.n0 = np.bincount(self.mid_word, self.t1, self.words).astype(np.int64)

    def totals(self) -> np.ndarray:
        return np.concatenate([
            np.bincount(self.leaf, self.n2, CONTEXTS), np.bincount(self.leaf, self.t2, CONTEXTS),
            np.bincount(self.mid, self.n1, PARENTS), np.bincount(self.mid, self.t1, PARENTS),
            [self.n0.sum(), self.t0.sum(), self.words, 0]])

    def root(self, all_: Totals) -> np.ndarray:
        return (self.n0 - all_.discount * self.t0) / (STRENGTH + all_.n0) + all_.base

    def parents(self, all_: Totals, root: np.ndarray) -> np.ndarray:
        return ((self.n1 - all_.discount * self.t1) / (STRENGTH + all_.n1[self.mid])
                + all_.open1[self.mid] * root[self.mid_word])

    def leaves(self, all_: Totals) -> np.ndarray:
        parent = self.parents(all_, self.root(all_))
        return ((self.n2 - all_.discount * self.t2) / (STRENGTH + all_.n2[self.leaf])
                + all_.open2[self.leaf] * parent[self.up])

    def sweep(self, all_: Totals, stirling: np.ndarray, rng) -> None:
        root = self.root(all_)
        parent = self.parents(all_, root)
        d = all_.discount
        self.t2 = draw_tables(self.n2, (STRENGTH + d * all_.t2[self.leaf]) * parent[self.up], d, stirling, rng)
        self.settle()
        self.t1 = draw_tables(self.n1, (STRENGTH + d * all_.t1[self.mid]) * root[self.mid_word], d, stirling, rng)
        self.settle()
        self.t0 = draw_tables(self.n0, np.full(self.words, (STRENGTH + d * all_.t0) * all_.uniform), d, stirling, rng)

    def predictive(self, all_: Totals, word: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Probability of words (-1: unknown) in contexts."""
        root = np.concatenate([self.root(all_), [all_.base]])[word]
        mid = leaf // PER_PARENT

        def found(keys, wanted, values):
            if not len(keys):
                return np.zeros(len(wanted))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where((keys[at] == wanted) & (word >= 0), values[at], 0.0)

        parent = found(self.mid_word * PARENTS + self.mid, word * PARENTS + mid,
                       (self.n1 - all_.discount * self.t1)) / (STRENGTH + all_.n1[mid]) + all_.open1[mid] * root
        return found(self.word * CONTEXTS + self.leaf, word * CONTEXTS + leaf,
                     (self.n2 - all_.discount * self.t2)) / (STRENGTH + all_.n2[leaf]) + all_.open2[leaf] * parent


class WordSeating:
    """The restaurants of whole words over those of endings, for one bucket's words.

    Pairs are ascending by word and have ``at``, the place of the context; ``ends`` has the ending of each context.
    """

    def __init__(self, word: np.ndarray, at: np.ndarray, counts: np.ndarray, ends: np.ndarray, words: int):
        self.word, self.at, self.n3, self.ends = word, at, counts, ends
        pairs, self.up = np.unique(word * CONTEXTS + ends[at], return_inverse=True)
        self.t3 = np.ones(len(word), np.int64)
        self.base = Seating(pairs, np.bincount(self.up, minlength=len(pairs)), words)

    def tables(self) -> np.ndarray:
        """This bucket's tables of each context."""
        return np.bincount(self.at, self.t3, len(self.ends)).astype(np.int64)

    def state(self) -> np.ndarray:
        """All tables, from which the customers of the parents follow."""
        return np.concatenate([self.t3, self.base.t2, self.base.t1, self.base.t0])

    def restore(self, state: np.ndarray) -> None:
        base = self.base
        self.t3, base.t2, base.t1, base.t0 = np.split(
            state.astype(np.int64), np.cumsum([len(self.t3), len(base.t2), len(base.t1)]))
        base.n2 = np.bincount(self.up, self.t3, len(base.word)).astype(np.int64)
        base.settle()

    def sweep(self, all_: Totals, tables: np.ndarray, discount: float, stirling3, stirling, rng) -> None:
        chance = (STRENGTH + discount * tables[self.at]) * self.base.leaves(all_)[self.up]
        self.t3 = draw_tables(self.n3, chance, discount, stirling3, rng)
        self.base.n2 = np.bincount(self.up, self.t3, len(self.base.word)).astype(np.int64)
        self.base.sweep(all_, stirling, rng)

    def predictive(self, all_: Totals, customers: np.ndarray, tables: np.ndarray, discount: float,
                   word: np.ndarray, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Probability of words (-1: unknown) in contexts, given all customers and tables of each context.

        ``pair`` is the place of word and context among the pairs, -1 where they were not trained.
        """
        own = np.append(self.n3 - discount * self.t3, 0.0)[pair]
        return (own + (STRENGTH + discount * tables[at]) * self.base.predictive(all_, word, self.ends[at])) / (
            STRENGTH + customers[at])


class Totals:
    """Customers and tables of whole restaurants, and what follows from them."""

    def __init__(self, sums: np.ndarray, discount: float):
        self.discount = discount
        self.n2, self.t2, self.n1, self.t1, rest = np.split(
            sums, np.cumsum([CONTEXTS, CONTEXTS, PARENTS, PARENTS]))
        self.n0, self.t0, self.words = rest[:3]
        self.uniform = 1.0 / (self.words + 1)
        self.open2 = (STRENGTH + discount * self.t2) / (STRENGTH + self.n2)
        self.open1 = (STRENGTH + discount * self.t1) / (STRENGTH + self.n1)
        self.base = (STRENGTH + discount * self.t0) / (STRENGTH + self.n0) * self.uniform


def _pack_keys(keys: np.ndarray) -> bytes:
    """Steps between mostly ascending keys, byte by byte: high bytes are alike."""
    return zstandard.compress(np.diff(keys, prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_keys(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())


def _settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``, after which the driver's garbage goes, and with it shuffle files that nothing needs any more."""
    out = stored(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in 32 bits where all of them fit, else in 64, which the first byte says."""
    narrow = not len(counts.ravel()) or counts.max() < 1 << 31
    return (b"4" if narrow else b"8") + pack_array(counts.astype(np.int32 if narrow else np.int64))


def _unpack_counts(blob: bytes) -> np.ndarray:
    return unpack_array(blob[1:], np.int32 if blob[:1] == b"4" else np.int64)


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _pair_counts(table: pa.Table):
    """What a chunk has: its distinct words, the key of each, the (word, context) pairs and the documents.

    Words ascend, and pairs ascend by word and context key, so that both sides of an answer number them
    alike. Pairs come as word, place of the context's word, and training count, 0 if held out only;
    documents as id, whether trained, tokens' words and pairs.
    """
    # Ends follow texts, so the token before a text's first is an end as well.
    place: dict[bytes, int] = defaultdict(itertools.count().__next__)
    end = place[END]
    seen, edges, docs = array("i"), [0], []
    for doc_id, trained, text in unpacked(table):
        seen.extend(map(place.__getitem__, _tokens(text)))
        seen.append(end)
        edges.append(len(seen))
        docs.append((doc_id, trained))
    seen = np.frombuffer(seen, np.int32)
    words = list(place)
    order = sorted(range(len(words)), key=words.__getitem__)
    words = [words[i] for i in order]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    keys = context_keys(words)
    by_key = np.argsort(keys, kind="stable")
    key_rank = np.empty(len(words), np.int64)
    key_rank[by_key] = np.arange(len(words))
    own = rank[seen]
    pairs, back = np.unique(own * len(words) + key_rank[np.concatenate([rank[[end]], own[:-1]])], return_inverse=True)
    trained = np.repeat([trained for _, trained in docs], np.diff(edges))
    counts = np.bincount(back, trained, len(pairs)).astype(np.int64)
    return words, keys, pairs // len(words), by_key[pairs % len(words)], counts, [
        (doc_id, trained, own[a:b], back[a:b]) for (doc_id, trained), a, b in zip(docs, edges[:-1], edges[1:])]


def _dealt(words: list[bytes], word: np.ndarray, buckets: int):
    """(bucket, its words, pairs per word, its pairs) of a chunk, the last as indices."""
    first = np.searchsorted(word, np.arange(len(words) + 1))
    bucket_of = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
    order = np.argsort(bucket_of, kind="stable")
    stops = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
    for bucket in np.flatnonzero(np.diff(stops)).tolist():
        at = order[stops[bucket]:stops[bucket + 1]]
        n = first[at + 1] - first[at]
        yield bucket, at, n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def score(docs: DataFrame, held_out: Column, sweeps: int = 3, burn_in: int = 1, seed: int = 11,
          chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Score every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words in ASCII lower case and an end per document; a NULL or
    empty text has the end alone. ``held_out`` says which documents are not
    learned from. ``score`` is the log10 probability of the text, averaged over
    the sweeps after ``burn_in`` before the logarithm; ``perplexity`` follows
    from it. ``base_score`` is that of single words with half a count added.
    Without training documents all words are unknown. Repeated rows and NULL
    ids count like others; other columns are ignored.
    """
    chunks = chunk_count(docs, chunk_bytes)
    source = packed(docs, chunks, ~held_out)

    def count(table: pa.Table) -> pa.Table:
        words, keys, word, before, counts, _ = _pair_counts(table)
        rows = []
        for bucket, at, n, where in _dealt(words, word, chunks):
            contexts, places = np.unique(keys[before[where]], return_inverse=True)
            rows.append({"bucket": bucket, "chunk": table["chunk"][0].as_py(), "n": len(at),
                         "words": pack_words([words[i] for i in at]), "sizes": pack_array(n.astype(np.int32)),
                         "contexts": _pack_keys(contexts), "places": pack_array(places.astype(np.int32)),
                         "counts": pack_array(counts[where].astype(np.int32))})
        return pa.Table.from_pylist(rows, schema=_schema(_SENT))

    def merge(table: pa.Table) -> pa.Table:
        """All that a bucket is asked, with its training counts; then of each chunk the pairs that it asks for.

        Words and contexts are numbered in the chunks' order, so a chunk's pairs ascend.
        """
        place: dict[bytes, int] = {}
        words, keys, counts = [], [], []
        sent = table.to_pylist()
        for row in sent:
            ids = np.array([place.setdefault(w, len(place)) for w in unpack_words(row["words"], row["n"])], np.int64)
            words.append(np.repeat(ids, unpack_array(row["sizes"], np.int32)))
            keys.append(_unpack_keys(row["contexts"])[unpack_array(row["places"], np.int32)])
            counts.append(unpack_array(row["counts"], np.int32))
        rank = np.empty(len(place), np.int64)
        rank[np.fromiter((place[w] for w in sorted(place)), np.int64, len(place))] = np.arange(len(place))
        contexts, at = np.unique(np.concatenate(keys), return_inverse=True)
        edges = np.cumsum([0, *map(len, counts)])
        pair, back = np.unique(rank[np.concatenate(words)] * len(contexts) + at, return_inverse=True)
        total = np.bincount(back, np.concatenate(counts), len(pair)).astype(np.int64)
        # Contexts are kept by part.
        part = (contexts >> 10) % chunks
        order = np.argsort(part, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        contexts, bucket = contexts[order], table["bucket"][0].as_py()
        return pa.Table.from_pylist([{
            "bucket": bucket, "n": len(place),
            "sizes": pack_array(np.bincount(pair // len(contexts), minlength=len(place)).astype(np.int32)),
            "contexts": _pack_keys(contexts), "ends": pack_array((contexts % CONTEXTS).astype(np.int16)),
            "edges": pack_array(np.searchsorted(part[order], np.arange(chunks + 1)).astype(np.int32)),
            "places": pack_array(moved[pair % len(contexts)].astype(np.int32)), "counts": pack_array(total)}, *(
            {"bucket": bucket, "chunk": row["chunk"], "places": pack_array(np.diff(back[a:b], prepend=0).astype(np.int32))}
            for row, a, b in zip(sent, edges[:-1], edges[1:]))], schema=_schema(_MERGED))

    sent = source.groupBy("chunk").applyInArrow(count, _SENT)
    both = _settled(sent.groupBy("bucket").applyInArrow(merge, _MERGED), "words")
    merged, asks = both.where("chunk IS NULL").drop("chunk"), both.where("chunk IS NOT NULL")

    def asked_pairs(row):
        """Word, context and training count of each pair of a bucket, asked only ones too."""
        return (np.repeat(np.arange(row["n"]), unpack_array(row["sizes"], np.int32)),
                unpack_array(row["places"], np.int32).astype(np.int64), unpack_array(row["counts"], np.int64))

    def begin(row) -> WordSeating:
        word, at, counts = asked_pairs(row)
        kept = counts > 0
        known, word = np.unique(word[kept], return_inverse=True)
        return WordSeating(word, at[kept], counts[kept], unpack_array(row["ends"], np.int16).astype(np.int64), len(known))

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                contexts, edges = _unpack_keys(row["contexts"]), unpack_array(row["edges"], np.int32)
                for part in np.flatnonzero(np.diff(edges)):
                    yield pa.RecordBatch.from_pylist([{
                        "part": part, "bucket": row["bucket"],
                        "sums": _pack_keys(contexts[edges[part]:edges[part + 1]])}], schema=_schema(_DEALT))

    def number(table: pa.Table) -> pa.Table:
        """Contexts of a part become numbers, which ascend: steps between them are kept."""
        asked = [_unpack_keys(s) for s in table["sums"].to_pylist()]
        _, ids = np.unique(np.concatenate(asked), return_inverse=True)
        edges = np.cumsum([0, *map(len, asked)])
        steps = [pack_array(np.diff(ids[a:b], prepend=0).astype(np.int32)) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table([table["part"], table["bucket"], pa.array(steps, pa.binary())], schema=_schema(_DEALT))

    numbered = _settled(merged.select("bucket", "contexts", "edges").mapInArrow(deal, _DEALT)
                      .groupBy("part").applyInArrow(number, _DEALT), "contexts")

    def hear(rows, edges) -> dict[int, np.ndarray]:
        """By number of sweeps made: the tables of each context, in the last line; before the first also all customers."""
        out: dict[int, np.ndarray] = {}
        for row in rows:
            k, part = -1 - row["chunk"], row["part"]
            if part >= 0:
                values = _unpack_counts(row["values"]).reshape(-1, edges[part + 1] - edges[part])
                out.setdefault(k, np.zeros((len(values), edges[-1]), np.int64))[:, edges[part]:edges[part + 1]] = values
        return out

    def states(rows) -> dict[int, np.ndarray]:
        """By number of sweeps made: the bucket's seating."""
        return {-1 - row["chunk"]: _unpack_counts(row["values"]) for row in rows if row["part"] == _STATE}

    def tell(row, seating: WordSeating, first: bool) -> list[dict]:
        edges = unpack_array(row["edges"], np.int32)
        sums = seating.tables()[None]
        if first:
            sums = np.concatenate([np.bincount(seating.at, seating.n3, edges[-1]).astype(np.int64)[None], sums])
        n3, n2 = seating.n3, seating.base.n2
        whole = np.concatenate([seating.base.totals(), [(n3 == 1).sum(), (n3 == 2).sum(), (n2 == 1).sum(),
                                                        (n2 == 2).sum(), n3.sum()]]).astype(float)
        state = [] if first else [{"part": _STATE, "bucket": row["bucket"], "sums": _pack_counts(seating.state())}]
        return [{"part": _TOTALS, "bucket": row["bucket"], "sums": pack_array(whole)}, *state, *(
            {"part": part, "bucket": row["bucket"],
             "sums": _pack_counts(sums[:, edges[part]:edges[part + 1]])}
            for part in np.flatnonzero(np.diff(edges)))]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = {r["bucket"]: _unpack_counts(r["sums"]) for r in right.to_pylist()}
        ids = {r["bucket"]: np.cumsum(unpack_array(r["sums"], np.int32)) for r in left.to_pylist()}
        lines = len(next(iter(sums.values()))) // len(ids[next(iter(sums))])
        total = np.zeros((lines, max(i[-1] for i in ids.values()) + 1), np.int64)
        for bucket, own in sums.items():
            total[:, ids[bucket]] += own.reshape(lines, -1)
        part = left["part"][0].as_py()
        return pa.Table.from_pylist([
            {"bucket": b, "part": part, "values": _pack_counts(total[:, i])} for b, i in ids.items()],
            schema=_schema("bucket int, part int, values binary"))

    def spread(batches):
        for batch in batches:
            for sums in batch["sums"].to_pylist():
                values = unpack_array(sums, float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)],
                                                 ["i", "v"])

    bare = merged.drop("contexts")
    heard, kept, history = None, [], []
    for k in range(sweeps + 1):
        if heard is None:
            def told(batches):
                for batch in batches:
                    for row in batch.to_pylist():
                        yield pa.RecordBatch.from_pylist(tell(row, begin(row), True), schema=_schema(_DEALT))

            up = bare.mapInArrow(told, _DEALT)
        else:
            def after(left: pa.Table, right: pa.Table) -> pa.Table:
                row, rows = left.to_pylist()[0], right.to_pylist()
                seating = begin(row)
                for state in states(rows).values():
                    seating.restore(state)
                tables = hear(rows, unpack_array(row["edges"], np.int32))[k - 1][-1]
                seating.sweep(history[-1], tables, discount, *stirling,
                              np.random.default_rng([seed, row["bucket"], k - 1]))
                return pa.Table.from_pylist(tell(row, seating, False), schema=_schema(_DEALT))

            up = bare.groupBy("bucket").cogroup(heard.groupBy("bucket")).applyInArrow(after, _DEALT)
        up = _settled(up, "tables")
        sums = np.zeros(2 * (CONTEXTS + PARENTS) + 9)
        for row in up.where(F.col("part") == _TOTALS).mapInArrow(spread, "i int, v double").groupBy("i").agg(
                F.sum("v").alias("v")).collect():
            sums[row["i"]] = row["v"]
        if not history:
            once, twice, once2, twice2, tokens = sums[-5:]
            discount = float(np.clip(once / max(once + 2 * twice, 1.0), 0.1, 0.95))
            below = float(np.clip(once2 / max(once2 + 2 * twice2, 1.0), 0.1, 0.95))
            stirling = log_stirling(discount), log_stirling(below)
        history = [*history, Totals(sums[:-5], below)]
        down = _settled(numbered.groupBy("part").cogroup(up.where("part >= 0").groupBy("part")).applyInArrow(
            add, "bucket int, part int, values binary"), "all-tables")
        heard = down.unionByName(up.where(F.col("part") == _STATE).withColumnRenamed("sums", "values")).select(
            "bucket", F.lit(-1 - k).cast("long").alias("chunk"), "part", "values")
        if k == 0 or k > burn_in:
            kept.append(heard)
    tokens, vocabulary = int(tokens), int(history[0].words)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        row = right.to_pylist()[0]
        asked = left.to_pylist()
        told = [r for r in asked if r["chunk"] < 0]
        tables, found, seating = hear(told, unpack_array(row["edges"], np.int32)), states(told), begin(row)
        word, at, counts = asked_pairs(row)
        seen = np.bincount(word, counts, row["n"]).astype(np.int64)
        known = np.where(seen > 0, np.cumsum(seen > 0) - 1, -1)[word]
        pair = np.where(counts > 0, np.cumsum(counts > 0) - 1, -1)
        p = np.zeros(len(word))
        for k in sorted(found):
            seating.restore(found[k])
            p += seating.predictive(history[k], tables[0][0], tables[k][-1], discount, known, at, pair)
        p, rows = (p / len(found)).astype(np.float32), []
        for r in asked:
            if r["chunk"] >= 0:
                own = np.cumsum(unpack_array(r["values"], np.int32))
                rows.append({"chunk": r["chunk"], "bucket": row["bucket"], "seen": pack_array(seen[np.unique(word[own])]),
                             "p": pack_array(p[own])})
        return pa.Table.from_pylist(rows, schema=_schema("chunk long, bucket int, seen binary, p binary"))

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        words, _, word, _, _, docs = _pair_counts(left)
        seen, logs = np.zeros(len(words), np.int64), np.zeros(len(word))
        answers = {r["bucket"]: r for r in right.to_pylist()}
        for bucket, at, _, where in _dealt(words, word, chunks):
            seen[at] = unpack_array(answers[bucket]["seen"], np.int64)
            logs[where] = np.log10(unpack_array(answers[bucket]["p"], np.float32).astype(float))
        base = np.log10((seen + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        rows = {k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for doc_id, trained, ids, at in docs:
            for name, value in zip(rows, (doc_id, not trained, len(ids), int((seen[ids] > 0).sum()),
                                          float(base[ids].sum()), float(logs[at].sum()))):
                rows[name].append(value)
        return pa.Table.from_pydict(rows, schema=pa.schema(
            [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
             ("base_score", pa.float64()), ("score", pa.float64())]))

    # Names of their own: Spark mixes up columns that both sides take from one table.
    asked_for = asks.select(F.col("bucket").alias("asked"), "chunk", F.lit(None).cast("int").alias("part"),
                            F.col("places").alias("values"))
    for known in kept:
        asked_for = asked_for.unionByName(known.withColumnRenamed("bucket", "asked"))
    answered = asked_for.groupBy("asked").cogroup(bare.groupBy("bucket")).applyInArrow(
        answer, "chunk long, bucket int, seen binary, p binary")
    done = source.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
                       "base_score", "score")


def perplexity(score_: Column, n_tokens: Column) -> Column:
    """Perplexity per token from a log10 probability."""
    return F.pow(F.lit(10.0), -score_ / n_tokens)
