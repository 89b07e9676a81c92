"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a shallow tree of
that feature alone to its lookup table; then pairs of features get tables in
the same way. A score is the sum of one table entry per feature and pair, so
scoring is a handful of vectorised bin additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import fold, thrifty
from gradeframe.llm.textarrays import Words, mix64, slices

FEATURES = (
    "log_words", "chars_per_word", "distinct_words", "letters", "digits", "capitals", "stops", "symbols",
    "words_without_letters", "words_in_capitals", "repeats_previous", "top_word", "distinct_pairs",
    "log_words_per_line", "shouts", "words_ending_in_symbols",
)


def _flags(*groups) -> np.ndarray:
    out = np.zeros(256, bool)
    for g in groups:
        out[list(g)] = True
    return out


_UPPER = _flags(range(0x41, 0x5B))
_LOWERCASE = _flags(range(0x61, 0x7B))
_LETTER = _flags(range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))
_DIGIT = _flags(range(0x30, 0x3A))
_STOP = _flags(b".,;:!?")
_CONTINUED = _flags(range(0x80, 0xC0))
_SPACE = _flags([0x20], range(0x09, 0x0E))
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | _SPACE | _flags(b"'\"()-"))


def features(words: Words) -> np.ndarray:
    """One row of ``FEATURES`` per text; a text without words has zeros."""
    data, n = words.data, words.counts
    some = np.maximum(n, 1)
    filled = np.maximum(words.per_doc_bytes(~_SPACE[data]), 1)

    def of_bytes(flags):
        return words.per_doc_bytes(flags[data]) / filled

    sums = {}

    def in_words(name, flags):
        if name not in sums:
            sums[name] = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return sums[name][words.stops] - sums[name][words.starts]

    letters, uppers = in_words("letter", _LETTER), in_words("upper", _UPPER)
    lowers = in_words("lower", _LOWERCASE)
    last = data[words.stops - 1] if len(words.stops) else np.zeros(0, np.uint8)
    h = words.hashes()
    same_doc = words.doc[1:] == words.doc[:-1]
    repeats = np.concatenate([[False], (h[1:] == h[:-1]) & same_doc]) if len(h) else np.zeros(0, bool)
    with np.errstate(over="ignore"):
        own = h ^ mix64(words.doc.astype(np.uint64))
        pair = mix64(own[:-1] + np.uint64(3) * mix64(own[1:]))[same_doc] if len(h) else np.zeros(0, np.uint64)
    _, at, times = np.unique(own, return_index=True, return_counts=True)
    distinct = np.bincount(words.doc[at], minlength=len(n))
    top = np.zeros(len(n))
    np.maximum.at(top, words.doc[at], times)
    _, at = np.unique(pair, return_index=True)
    pair_doc = words.doc[:-1][same_doc] if len(h) else np.zeros(0, np.int64)
    pairs = np.bincount(pair_doc[at], minlength=len(n))
    lines = words.per_doc_bytes(data == 0x0A) + 1
    chars = words.per_doc_bytes(~_CONTINUED[data] & ~_SPACE[data])
    out = np.stack([
        np.log1p(n), chars / some, distinct / some, of_bytes(_LETTER), of_bytes(_DIGIT), of_bytes(_UPPER),
        of_bytes(_STOP), of_bytes(_SYMBOL), words.per_doc(letters == 0) / some,
        words.per_doc((uppers >= 2) & (lowers == 0)) / some, words.per_doc(repeats) / some, top / some,
        pairs / np.maximum(n - 1, 1), np.log1p(n / lines),
        words.per_doc_bytes(data == 0x21) / filled, words.per_doc(_SYMBOL[last]) / some,
    ], axis=1)
    return np.where(n[:, None] > 0, out, 0.0)


@dataclass
class Gam:
    """``edges[f]``: bin edges; ``tables[f]``: one value per bin; ``pairs``: (f, g, values)."""

    intercept: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        b = self.bins(x)
        for table, rows in zip(self.tables, b):
            total += table[rows]
        for f, g, table in self.pairs:
            total += table[b[f], b[g]]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Best gain of one cut of a histogram, and how many bins lie before it."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl > least) & (hr > least), gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1), -1.0)
    if not len(gain):
        return 0.0, 0
    at = int(np.argmax(gain))
    return float(gain[at] - g.sum() ** 2 / (h.sum() + 1)), at + 1


def _shallow(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Leaf values per bin of a tree with up to four leaves."""
    out = np.zeros(len(g))
    pieces = [(0, len(g))]
    for _ in range(2):
        split = []
        for a, b in pieces:
            gain, at = _cut(g[a:b], h[a:b], least)
            split += [(a, a + at), (a + at, b)] if gain > 0 else [(a, b)]
        pieces = split
    for a, b in pieces:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15,
        interactions: int = 6, least: float = 3.0) -> Gam:
    """The model of labelled rows; without rows of both labels it is a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Gam(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _shallow(np.bincount(b[f], g, len(table)), np.bincount(b[f], h, len(table)), least)
            table += step
            total += step[b[f]]

    def grid(f, g_, values):
        m = len(model.tables[g_])
        return np.bincount(b[f] * m + b[g_], values, len(model.tables[f]) * m).reshape(-1, m)

    def tree(g, h):
        """One cut of the rows, and in either part one of the columns."""
        out, gain = np.zeros_like(g), 0.0
        _, at = _cut(g.sum(1), h.sum(1), least)
        for rows in (slice(0, at), slice(at, len(g))):
            if g[rows].size:
                more, cut = _cut(g[rows].sum(0), h[rows].sum(0), least)
                cut = cut if more > 0 else g.shape[1]
                for cols in (slice(0, cut), slice(cut, g.shape[1])):
                    s, w = g[rows, cols].sum(), h[rows, cols].sum()
                    gain += s * s / (w + 1)
                    out[rows, cols] = -s / (w + 1)
        return gain, out

    g, h = slopes()
    ranked = sorted(((tree(grid(i, j, g), grid(i, j, h))[0], i, j)
                     for i in range(len(b)) for j in range(len(b)) if i != j), reverse=True)
    chosen = []
    for _, i, j in ranked:
        if len(chosen) < interactions and (j, i) not in chosen:
            chosen.append((i, j))
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for i, j in chosen]
    for _ in range(rounds // 3):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = rate * tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[b[i], b[j]]
    return model


def feature_column(text: Column) -> Column:
    """``FEATURES`` of a text, as an array."""
    @F.arrow_udf("array<double>")
    @thrifty
    def measured(column: pa.Array) -> pa.Array:
        rows = [features(w) for w in slices(column, lower=False)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(
            np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32), x.ravel())

    return measured(text)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, **options) -> Gam:
    """Fit on labelled documents outside of the held-out fold (remainder 0 of 5).

    ``max_rows`` bounds the sample: the labelled ids with the smallest hashes.
    Only ids and labels of the sample are broadcast, and only its features, at
    most ``max_rows`` rows, come to the driver. Rows without id or quality are
    left out; repeated rows count as often as they are there.
    """
    chosen = (labels.where((fold(F.col("doc_id")) != 0) & F.col("quality").isNotNull())
              .select("doc_id", F.col("quality").cast("int").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "quality", feature_column(F.col("text")).alias("x"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows).toArrow())
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, (rows["quality"].to_numpy() > 0).astype(float), **options)


def score(text: Column, model: Gam) -> Column:
    """Probability that the text has quality 1; NULL and empty texts get that of zeros."""
    @F.arrow_udf("double")
    @thrifty
    def scored(column: pa.Array) -> pa.Array:
        parts = [model.probability(features(w)) for w in slices(column, lower=False)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return scored(text)
