"""Resampling documents towards a target distribution.

Features are the word n-grams of a text, hashed into buckets. The log ratio of
a bucket's frequency in a target table and in all documents is its gain; a
document's weight is the sum of the gains of its features, and adding Gumbel
noise to weights turns the highest scores into a sample without replacement.

Each batch interns its n-grams in an open-addressed table of NumPy arrays:
XXH64 of the bytes says where to look, and bytes are compared before two
occurrences share a slot. A slot keeps the bucket and the count, so buckets are
worked out once per distinct n-gram; occurrences keep their slot and gather the
slot's gain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import stored, thrifty
from gradeframe.llm.textarrays import Words, slices

BUCKETS = 10000

# Words are runs of ASCII digits, lower-case letters and bytes beyond ASCII.
_BREAK = np.ones(256, bool)
_BREAK[0x30:0x3A] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (  # fixed values of XXH64
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray, read: np.ndarray) -> np.ndarray:
    return _turn(lane + read * _P2, 31) * _P1


def xxh64(rows: np.ndarray) -> np.ndarray:
    """XXH64, seed 0, of each row of a matrix of bytes."""
    rows = np.ascontiguousarray(rows)
    n, size = rows.shape

    def word(at: int, width: int) -> np.ndarray:
        return np.ascontiguousarray(rows[:, at:at + width]).view(f"<u{width}").ravel().astype(np.uint64)

    at = 0
    with np.errstate(over="ignore"):
        if size >= 32:
            lanes = [np.full(n, seed, np.uint64) for seed in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            while at + 32 <= size:
                lanes = [_round(lane, word(at + 8 * k, 8)) for k, lane in enumerate(lanes)]
                at += 32
            out = sum(_turn(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                out = (out ^ _round(np.zeros(n, np.uint64), lane)) * _P1 + _P4
        else:
            out = np.full(n, _P5, np.uint64)
        out = out + np.uint64(size)
        while at + 8 <= size:
            out = _turn(out ^ _round(np.zeros(n, np.uint64), word(at, 8)), 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            out = _turn(out ^ word(at, 4) * _P1, 23) * _P2 + _P3
            at += 4
        for k in range(at, size):
            out = _turn(out ^ rows[:, k].astype(np.uint64) * _P5, 11) * _P1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        return out ^ (out >> np.uint64(32))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all bytes of spans, span after span."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Interned:
    """The distinct n-grams of a slice of texts.

    ``slot``: where each occurrence lives in the table. ``doc``: its text.
    ``bucket`` and ``count``: of each slot; empty slots have count 0.
    """

    def __init__(self, words: Words, longest: int, buckets: int):
        sizes = words.stops - words.starts
        # Words end to end with one blank behind each, so an n-gram is one span of bytes.
        data = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        data[_flat(begin, sizes)] = words.data[_flat(words.starts, sizes)]
        starts, stops, docs = [], [], []
        for n in range(1, longest + 1):
            last = np.arange(n - 1, len(sizes))
            last = last[words.doc[last] == words.doc[last - (n - 1)]]
            starts.append(begin[last - (n - 1)])
            stops.append(begin[last] + sizes[last])
            docs.append(words.doc[last])
        self.data, self.doc = data, np.concatenate(docs)
        self.start, stop = np.concatenate(starts), np.concatenate(stops)
        self.size = stop - self.start
        self.key = self._keys()
        self._intern()
        self.bucket = np.zeros(len(self.owner), np.int64)
        used = np.flatnonzero(self.owner >= 0)
        raw, at = self.data.tobytes(), self.owner[used]
        self.bucket[used] = np.fromiter(
            (zlib.crc32(raw[a:b]) % buckets for a, b in zip(self.start[at].tolist(), (self.start + self.size)[at].tolist())),
            np.int64, len(used))
        self.count = np.bincount(self.slot, minlength=len(self.owner))

    def _keys(self) -> np.ndarray:
        keys = np.zeros(len(self.size), np.uint64)
        order = np.argsort(self.size, kind="stable")
        edges = np.flatnonzero(np.diff(self.size[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            width = int(self.size[order[a]])
            step = max(1, (4 << 20) // width)
            for at in range(a, b, step):
                part = order[at:min(at + step, b)]
                keys[part] = xxh64(self.data[self.start[part][:, None] + np.arange(width)])
        return keys

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences a and b are the same bytes."""
        same = (self.key[a] == self.key[b]) & (self.size[a] == self.size[b])
        check = np.flatnonzero(same & (a != b))
        total = np.cumsum(self.size[a[check]])
        at = 0
        while at < len(check):  # a few million bytes at once
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (4 << 20), side="right")))
            part = check[at:stop]
            sizes = self.size[a[part]]
            differ = self.data[_flat(self.start[a[part]], sizes)] != self.data[_flat(self.start[b[part]], sizes)]
            same[part] = ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)
            at = stop
        return same

    def _intern(self) -> None:
        n = len(self.key)
        width = 1 << max(1, (2 * n - 1).bit_length())
        self.owner = np.full(width, -1)
        self.slot = (self.key & np.uint64(width - 1)).astype(np.int64)
        left = np.arange(n)
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several one gets the slot, the others compare with it
            left = left[~self._same(self.owner[at], left)]
            self.slot[left] = (self.slot[left] + 1) & (width - 1)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of features per bucket over all rows.

    A task sums its batches before anything leaves it, so it sends at most
    ``buckets`` rows, and as many come to the driver.
    """
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in slices(batch.column(0), True, _BREAK):
                if len(words.starts):
                    seen = Interned(words, longest, buckets)
                    total += np.bincount(seen.bucket, seen.count, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = texts.select(F.col(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in found.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed frequencies in target and source, rounded down."""
    buckets = len(source)
    all_source, all_target = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(
        (t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(text: Column, gains: np.ndarray, longest: int = 1) -> Column:
    """(n_words, n_features, weight) of a text: how many, and the sum of its features' gains; zeros for NULL."""
    buckets = len(gains)

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, weight: bigint>")
    @thrifty
    def weighed(column: pa.Array) -> pa.Array:
        parts = []
        for words in slices(column, True, _BREAK):
            n = len(words.counts)
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(words.starts):
                seen = Interned(words, longest, buckets)
                features = np.bincount(seen.doc, minlength=n)
                # Doubles hold these sums of integers exactly.
                weight = np.bincount(seen.doc, gains[seen.bucket][seen.slot], n).astype(np.int64)
            parts.append((words.counts, features, weight))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["n_words", "n_features", "weight"])

    return weighed(text)


def gumbel(doc_id: Column, seed: int = 2024) -> Column:
    """Thousandths of Gumbel noise from the digest of seed and id, rounded down; a NULL id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(weighed: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """Rank of the drawn rows: of those with ``min_words`` words the floor of ``percent`` % with the highest scores.

    Ties go to the smaller doc_id, NULL last; rows that agree in both are
    ordered by their place in a table written before. Spark sorts all rows by
    ranges; positions within a range and the sizes of the ranges before it give
    the rank, so nobody sees all rows. One row per range is broadcast.
    """
    late = (~(F.col("n_words") >= min_words)).cast("int")
    rows = stored(weighed.withColumn("_late", late).withColumn("_place", F.monotonically_increasing_id()), "weights")
    order = [F.col("_late"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_place")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The id's upper bits are the task, the lower 33 count its rows.
    numbered = stored(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn(
        "_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)), "ranks")
    sizes = numbered.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("_late")).alias("in_time")).collect()
    able, before, first = sum(r["in_time"] for r in sizes), 0, []
    for r in sorted(sizes, key=lambda r: r["_range"]):
        first.append((r["_range"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(first, "_range long, _before long")
    drawn = percent * able // 100
    rank = F.col("_before") + F.col("_at") + 1
    return (numbered.join(F.broadcast(starts), "_range")
            .withColumn("rank", F.when((F.col("_late") == 0) & (rank <= drawn), rank))
            .drop("_range", "_before", "_at", "_late", "_place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1,
             buckets: int = BUCKETS, seed: int = 2024, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Draw documents that look like ``target``: doc_id, n_words, n_features, weight, score and rank, NULL if not drawn.

    Features are all runs of 1 to ``longest`` words, joined by one blank. Texts
    are read whole, twice, and don't move. Every row of ``docs`` gives a row, with
    the columns named in ``keep``; other columns are ignored. NULL and empty
    texts have no features and weight 0. Repeated rows are documents of their
    own; rows without id share their noise. An empty target still gives gains,
    from the smoothing alone; without documents the result is empty.
    """
    source = bucket_counts(docs, text, longest, buckets)
    gains = bucket_gains(source, bucket_counts(target, text, longest, buckets))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c) for c in keep],
                        weigh(F.col(text), gains, longest).alias("_found"))
    scored = found.select("doc_id", *keep, "_found.*").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, percent, min_words)
