"""Words of many texts at once, as arrays, from the buffers of an Arrow column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are taken in slices of about this many bytes; one longer text is a slice.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """``data``: bytes of the slice, texts end to end with a blank behind each.

    ``bounds``: where text i begins, one more than texts. ``starts``, ``stops``:
    of words in ``data``. ``first``: index of the first word of each text, one
    more than texts. ``doc``: the text of each word.
    """

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64 bits of each word, from sums of its bytes times weights of their places."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        inside = np.repeat(np.cumsum(self.stops - self.starts) - (self.stops - self.starts),
                           self.stops - self.starts)
        place = np.arange(len(inside), dtype=np.int64) - inside
        letters = self.data[place + np.repeat(self.starts, self.stops - self.starts)]
        del inside
        weights = mix64(np.arange(int(place.max()) + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            terms = (letters.astype(np.uint64) + np.uint64(1)) * weights[place]
            begin = np.cumsum(self.stops - self.starts) - (self.stops - self.starts)
            return mix64(np.add.reduceat(terms, begin))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per word over each text."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def per_doc_bytes(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per byte over each text."""
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def slices(column, lower: bool, blank: np.ndarray = _BLANK):
    """``Words`` for consecutive slices of an Arrow string column; NULL reads as empty.

    ``blank`` says of each byte, after it is lower-cased, whether it separates words.
    """
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from slices(chunk, lower, blank)
        return
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at:])
        stop = at + max(1, int(np.searchsorted(total, SLICE_BYTES, side="right")))
        yield _words(data, offsets[at:stop], sizes[at:stop], lower, blank)
        at = stop


def _words(data, offsets, sizes, lower, separates) -> Words:
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], 0x20, np.uint8)
    if len(sizes) and (sizes.sum() == offsets[-1] + sizes[-1] - offsets[0]):
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = data[offsets[0]:offsets[-1] + sizes[-1]]
    else:
        for b, o, n in zip(bounds, offsets, sizes):
            out[b:b + n] = data[o:o + n]
    if lower:
        out = _LOWER[out]
    blank = separates[out]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, bounds)
    doc = np.repeat(np.arange(len(sizes)), np.diff(first))
    return Words(out, bounds, starts, stops, first, doc)
