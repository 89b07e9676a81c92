"""Language of words and texts by a linear-chain conditional random field.

Each word with a letter is a position of the chain; its label is a language.
Affixes, byte n-grams and membership in a learned lexicon speak for labels,
and learned transitions tie neighbours together. Labels of a code-switched text
come from forward-backward; a text's language is the one with the largest mean
posterior over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.common import fold, thrifty
from gradeframe.llm.textarrays import Words, mix64, slices

BUCKETS = 1 << 17
UNKNOWN = "und"
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ASCII = _LETTERS.copy()
_ASCII[0x80:] = False


@dataclass
class Chain:
    """``weights``: buckets by labels; ``transitions``: from label (row) to label."""

    labels: list[str]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray


def _spelled(words: Words) -> tuple[Words, np.ndarray]:
    """Words that have a letter, and which of all words they are."""
    sums = np.concatenate([[0], np.cumsum(_LETTERS[words.data])])
    kept = np.flatnonzero(sums[words.stops] > sums[words.starts])
    first = np.searchsorted(kept, words.first)
    return Words(words.data, words.bounds, words.starts[kept], words.stops[kept], first, words.doc[kept]), kept


def _features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray,
              lexicon: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (bucket, word it belongs to), the words ascending within each group."""
    n = len(starts)
    padded = np.concatenate([[0x20] * 5, data, [0x20] * 5]).astype(np.uint64)
    starts, stops = starts + 5, stops + 5
    groups = []
    lengths = stops - starts
    for size in (2, 3):  # n-grams, one blank beyond either end included
        windows = np.maximum(lengths + 3 - size, 0)
        owner = np.repeat(np.arange(n), windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner] - 1
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key = key << np.uint64(8) | padded[at + k]
        groups.append((key | np.uint64(size << 40), owner))
    for size in (1, 2, 3, 4):  # affixes
        for kind in (0, 1):
            inside = np.flatnonzero(lengths >= size)
            key = np.zeros(len(inside), np.uint64)
            for k in range(size):
                at = starts[inside] + k if kind == 0 else stops[inside] - size + k
                key = key << np.uint64(8) | padded[at]
            groups.append((key | np.uint64((8 + size * 2 + kind) << 40), inside))
    if len(lexicon):
        spot = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
        known = lexicon[spot] == hashes
    else:
        known = np.zeros(n, bool)
    groups.append((np.where(known, hashes, np.uint64(1)), np.arange(n)))
    return [((mix64(key) % np.uint64(BUCKETS)).astype(np.int64), owner) for key, owner in groups]


def _sums(groups: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    """Sum of the weights of each word's buckets."""
    out = np.zeros((n, weights.shape[1]))
    for bucket, owner in groups:
        if len(owner):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = weights[bucket]
            out[owner[begin]] += rows if len(begin) == len(owner) else np.add.reduceat(rows, begin, axis=0)
    return out


def _emissions(words: Words, model: Chain) -> np.ndarray:
    """Score of each word and label; words that occur again are scored once."""
    if not len(words.starts):
        return np.zeros((0, len(model.labels)))
    hashes = words.hashes()
    distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    groups = _features(words.data, words.starts[at], words.stops[at], distinct, model.lexicon)
    return _sums(groups, model.weights, len(distinct))[back]


def posteriors(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward over all chains at once, longest first, in scaled probabilities."""
    potential = np.exp(emissions - emissions.max(1, keepdims=True, initial=-np.inf))
    move = np.exp(transitions - transitions.max())
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha = np.empty_like(potential)
    out = np.empty_like(potential)
    tiny = 1e-300
    for t in range(steps):
        rows = begin[:active[t]] + t
        now = potential[rows] if t == 0 else (before[:active[t]] @ move) * potential[rows]
        now /= now.sum(1, keepdims=True) + tiny
        alpha[rows] = before = now
    after = np.ones((0, potential.shape[1]))
    for t in range(steps - 1, -1, -1):
        rows = begin[:active[t]] + t
        after = np.concatenate([after, np.ones((active[t] - len(after), potential.shape[1]))])
        both = alpha[rows] * after
        out[rows] = both / (both.sum(1, keepdims=True) + tiny)
        after = (potential[rows] * after) @ move.T
        after /= after.sum(1, keepdims=True) + tiny
    return out


def fit(texts: list[tuple[str, str]], sequences: int = 3000, epochs: int = 40, seed: int = 7) -> Chain:
    """Learn from (text, language) pairs.

    The chains are runs of 4 to 24 words from one to four texts of random
    languages end to end, so that transitions are learned as well. The lexicon
    holds words that occur twice. Gradients are those of the exact likelihood.
    """
    labels = sorted({lang for _, lang in texts})
    empty = Chain(labels, np.zeros(0, np.uint64), np.zeros((BUCKETS, len(labels))),
                  np.zeros((len(labels), len(labels))))
    if len(labels) < 2:
        return empty
    words = [_spelled(w)[0] for w in slices(pa.array([t for t, _ in texts]), lower=True)]
    data = np.concatenate([w.data for w in words])
    shift = np.cumsum([0] + [len(w.data) for w in words])
    starts = np.concatenate([w.starts + s for w, s in zip(words, shift)])
    stops = np.concatenate([w.stops + s for w, s in zip(words, shift)])
    hashes = np.concatenate([w.hashes() for w in words])
    counts = np.concatenate([w.counts for w in words])
    begin = np.cumsum(counts) - counts
    code = {lang: i for i, lang in enumerate(labels)}
    of_label = [[i for i, (_, lang) in enumerate(texts) if code[lang] == k and counts[i]] for k in range(len(labels))]
    usable = [k for k in range(len(labels)) if of_label[k]]
    if not usable:
        return empty
    rng = np.random.default_rng(seed)
    chains, tags = [], []
    for _ in range(sequences):
        chain, tag = [], []
        for _ in range(rng.integers(1, 5)):
            k = int(rng.choice(usable))
            i = of_label[k][rng.integers(len(of_label[k]))]
            size = min(int(rng.integers(4, 25)), int(counts[i]))
            at = begin[i] + rng.integers(counts[i] - size + 1)
            chain.append(np.arange(at, at + size))
            tag.append(np.full(size, k))
        chains.append(np.concatenate(chain))
        tags.append(np.concatenate(tag))
    tokens, tag = np.concatenate(chains), np.concatenate(tags)
    first = np.concatenate([[0], np.cumsum([len(c) for c in chains])])
    distinct, at, back = np.unique(hashes[tokens], return_index=True, return_inverse=True)
    seen, times = np.unique(hashes, return_counts=True)
    lexicon = seen[times >= 2]
    groups = _features(data, starts[tokens[at]], stops[tokens[at]], distinct, lexicon)
    buckets, owner = (np.concatenate(x) for x in zip(*groups))
    n, m = len(labels), len(tokens)
    weights, moves = np.zeros((BUCKETS, n)), np.zeros((n, n))
    square_w, square_m = np.full((BUCKETS, n), 1e-8), np.full((n, n), 1e-8)
    inner = np.ones(m, bool)
    inner[first[1:] - 1] = False
    here = np.flatnonzero(inner)
    gold_moves = np.bincount(tag[here] * n + tag[here + 1], minlength=n * n).reshape(n, n)
    gold = np.eye(n)[tag]
    for _ in range(epochs):
        scores = _sums(groups, weights, len(distinct))[back]
        marginal, expected = _expectations(scores, first, moves, here)
        slope = np.stack([np.bincount(back, (gold - marginal)[:, k], len(distinct)) for k in range(n)], 1)
        grad = np.stack([np.bincount(buckets, slope[owner, k], BUCKETS) for k in range(n)], 1) - 0.05 * weights
        square_w += grad ** 2
        weights += 0.3 * grad / np.sqrt(square_w)
        grad_m = gold_moves - expected - 0.05 * moves
        square_m += grad_m ** 2
        moves += 0.3 * grad_m / np.sqrt(square_m)
    return Chain(labels, lexicon, weights, moves)


def _expectations(scores, first, moves, here):
    """Marginals of words and expected numbers of transitions."""
    marginal = posteriors(scores, first, moves)
    potential = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(moves - moves.max())
    # Backward messages follow from marginals: pair(t) is forward times backward of its ends.
    forward = _forward(potential, first, move)
    ahead = marginal[here + 1] / np.maximum(forward[here] @ move, 1e-300)
    pairs = forward[here][:, :, None] * move[None] * ahead[:, None, :]
    pairs /= pairs.sum((1, 2), keepdims=True)
    return marginal, pairs.sum(0)


def _forward(potential, first, move):
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    alpha = np.empty_like(potential)
    for t in range(int(lengths[0])):
        rows = begin[:np.searchsorted(-lengths, -t, side="left")] + t
        now = potential[rows] if t == 0 else (before[:len(rows)] @ move) * potential[rows]
        alpha[rows] = before = now / now.sum(1, keepdims=True)
    return alpha


def train(docs: DataFrame, max_documents: int = 2500, window: int = 1500, least: int = 50,
          **options) -> Chain:
    """Learn from documents with a language outside of the held-out fold (remainder 0 of 5).

    ``max_documents`` bounds the sample: the ids with the smallest hashes, first
    ``least`` of each language, so that rare ones are learned as well, then over
    all languages together. With more than ``max_documents / least`` languages
    those whose ids have the smallest hashes come first. ``window`` bounds the
    characters taken of each, from a place given by the hash. Only text and
    language are used; of rows that repeat an id one is taken. Without two
    languages the model is trivial.
    """
    labelled = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    key = F.xxhash64("doc_id")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id"))
    ranked = labelled.select("doc_id", "lang").distinct().withColumn("turn", turn).where(F.col("turn") <= max_documents)
    # An id has one place, whatever number of languages its rows name.
    chosen = (ranked.groupBy("doc_id").agg(F.min("turn").alias("turn"))
              .orderBy(F.col("turn") > least, key, "doc_id").limit(max_documents).select("doc_id"))
    place = 1 + F.pmod(key, F.greatest(F.length("text") - window, F.lit(1))).cast("int")
    rows = (labelled.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")
            .select("doc_id", F.struct("lang", F.substring(F.col("text"), place, F.lit(window)).alias("text")).alias("row"))
            .groupBy("doc_id").agg(F.min("row").alias("row")).orderBy("doc_id").select("row.*").collect())
    return fit([(r["text"], r["lang"]) for r in rows], **options)


def _has_letter(words: Words) -> np.ndarray:
    plain = words.per_doc_bytes(_ASCII[words.data]) > 0
    for i in np.flatnonzero(~plain & (words.per_doc_bytes(words.data >= 0x80) > 0)):
        text = words.data[words.bounds[i]:words.bounds[i + 1]].tobytes().decode("utf-8", "replace")
        plain[i] = any(c.isalpha() for c in text)
    return plain


def identify(text: Column, model: Chain) -> Column:
    """(lang_pred, score) of each text: ``und`` and 0 for NULL and for texts without a letter."""

    @F.arrow_udf("lang_pred string, score double")
    @thrifty
    def identified(column: pa.Array) -> pa.Array:
        names, scores = [], []
        for words in slices(column, lower=True):
            known = _has_letter(words)
            spelled, _ = _spelled(words)
            if model.labels:
                p = posteriors(_emissions(spelled, model), spelled.first, model.transitions)
                sums = np.stack([spelled.per_doc(p[:, k]) for k in range(p.shape[1])], 1)
                mean = sums / np.maximum(spelled.counts, 1)[:, None]
                best = mean.argmax(1)
                names += [model.labels[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores.append(np.where(known, np.clip(mean.max(1), 0, 1), 0.0))
            else:
                names += [UNKNOWN] * len(known)
                scores.append(np.zeros(len(known)))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()),
             pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())],
            ["lang_pred", "score"])

    return identified(text)


def label_words(text: Column, model: Chain) -> Column:
    """Language and posterior of each word with a letter, in order; empty for NULL."""

    @F.arrow_udf("array<struct<word:string,lang:string,score:double>>")
    @thrifty
    def labelled(column: pa.Array) -> pa.Array:
        out = []
        for words in slices(column, lower=False):
            spelled, _ = _spelled(words)
            lowered = Words(np.where((words.data >= 0x41) & (words.data < 0x5B), words.data + 0x20, words.data),
                            words.bounds, spelled.starts, spelled.stops, spelled.first, spelled.doc)
            p = posteriors(_emissions(lowered, model), spelled.first, model.transitions)
            for a, b in zip(spelled.first[:-1], spelled.first[1:]):
                out.append([{"word": words.data[spelled.starts[i]:spelled.stops[i]].tobytes().decode(
                                 "utf-8", "replace"),
                             "lang": model.labels[p[i].argmax()] if model.labels else UNKNOWN,
                             "score": float(p[i].max(initial=0.0))} for i in range(a, b)])
        return pa.array(out, pa.list_(pa.struct(
            [("word", pa.string()), ("lang", pa.string()), ("score", pa.float64())])))

    return labelled(text)
