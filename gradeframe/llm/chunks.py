"""Documents dealt into chunks of bounded size, and tables of the distinct words of each.

A chunk is a set of documents with the same hash, about ``CHUNK_BYTES`` of text
together. What depends on a word alone is worked out once per distinct word:
chunks send their distinct words, packed by the word's hash, and get back one
answer for each. Texts move once, compressed; a word that is everywhere moves
once per chunk.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import give_back

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20  # text whose distinct words a bucket holds
PACKED = "chunk long, doc_ids array<long>, flags array<boolean>, sizes array<int>, texts binary"
_PACKED_ARROW = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
    ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Number of chunks for all texts, from their total size."""
    return max(1, -(-_text_bytes(docs) // chunk_bytes))


def chunk_and_bucket_counts(docs: DataFrame, chunk_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Numbers of chunks and of buckets of words, each from the total size of all texts alone."""
    total = _text_bytes(docs)
    return max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def packed(docs: DataFrame, chunks: int, flag: Column | None = None) -> DataFrame:
    """Rows of ``PACKED``: the documents of one chunk among those of one Arrow batch.

    ``flag`` is kept for each document. NULL texts become empty.
    """
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"),
        (flag if flag is not None else F.lit(False)).alias("flag"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def pack(batches):
        for batch in (part for whole in batches for part in _parts(whole)):
            table = pa.Table.from_batches([batch]).sort_by("chunk").combine_chunks()
            chunk = table["chunk"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
            ids, flags, texts = (table[c].combine_chunks() for c in ("doc_id", "flag", "text"))
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                part = texts.slice(a, b - a).to_pylist()
                out.append({"chunk": int(chunk[a]), "doc_ids": ids.slice(a, b - a).to_pylist(),
                            "flags": flags.slice(a, b - a).to_pylist(), "sizes": [len(t) for t in part],
                            "texts": zstandard.compress(b"".join(part), 1)})
            del table, ids, flags, texts, part
            yield pa.RecordBatch.from_pylist(out, schema=_PACKED_ARROW)
            give_back()

    return rows.mapInArrow(pack, PACKED)


def _parts(batch: pa.RecordBatch):
    """A batch in parts of about 16 MB, so that sorting copies no more than that at once."""
    rows = max(1, batch.num_rows * (16 << 20) // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def unpacked(table: pa.Table):
    """(doc_id, flag, text bytes) of each document of a group of ``PACKED`` rows."""
    for row in range(table.num_rows):
        ids, flags, sizes, texts = (table[c][row].as_py() for c in ("doc_ids", "flags", "sizes", "texts"))
        texts = zstandard.decompress(texts, max_output_size=max(1, sum(sizes)))
        at = 0
        for doc_id, flag, size in zip(ids, flags, sizes):
            yield doc_id, flag, texts[at:at + size]
            at += size


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.compress(sizes.tobytes() + b"".join(words), 1)


def unpack_words(blob: bytes, count: int) -> list[bytes]:
    raw = zstandard.decompress(blob)
    stops = np.cumsum(np.frombuffer(raw, np.uint32, count), dtype=np.int64) + 4 * count
    bounds = [4 * count, *stops.tolist()]
    return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def pack_array(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpack_array(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), dtype)


def by_bucket(words: list[bytes], buckets: int) -> dict[int, list[int]]:
    """Indices of words by the bucket of their hash."""
    out: dict[int, list[int]] = {}
    crc = zlib.crc32
    for i, w in enumerate(words):
        out.setdefault(crc(w) % buckets, []).append(i)
    return out
