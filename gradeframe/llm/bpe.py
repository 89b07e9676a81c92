"""Byte-level BPE through one global shuffle of distinct pre-tokens.

Texts are cut into pre-tokens; each chunk of documents sends its distinct
pre-tokens to where each distinct one is encoded once; the ids come back to the
chunk and are put together by position. Decoding looks ids up in the table of
token bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.chunks import (
    BUCKET_BYTES, CHUNK_BYTES, by_bucket, chunk_and_bucket_counts, pack_array, pack_words, packed, unpack_array,
    unpack_words, unpacked,
)
from gradeframe.llm.common import give_back, thrifty


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _sent(source: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """The distinct pre-tokens of each chunk, a row for each bucket that some belong to."""
    @thrifty
    def distinct(table: pa.Table) -> pa.Table:
        import regex

        cut, seen = regex.compile(pattern).findall, set()
        for _, _, text in unpacked(table):
            seen.update(cut(text.decode("utf-8")))
        words = [w.encode("utf-8") for w in seen]
        rows = [{"bucket": b, "chunk": table["chunk"][0].as_py(), "n": len(at), "words": pack_words([words[i] for i in at])}
                for b, at in by_bucket(words, buckets).items()]
        return pa.Table.from_pylist(rows, schema=pa.schema(
            [("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("words", pa.binary())]))

    return source.groupBy("chunk").applyInArrow(distinct, "bucket int, chunk long, n int, words binary")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk_bytes: int = CHUNK_BYTES,
           bucket_bytes: int = BUCKET_BYTES, decoded: bool = False) -> DataFrame:
    """Ids of every text: (doc_id, ids array<int>), one row per row of ``docs``.

    With ``decoded`` also the bytes that the ids stand for, looked up in the token
    table where the ids are, which saves sending all ids to another worker for ``decode``.

    ``pattern`` cuts a text into pre-tokens, each encoded separately; there are
    no special tokens. NULL and empty texts give an empty array. Repeated rows
    and NULL ids are kept. Only doc_id and text are read. A chunk and its
    distinct pre-tokens fit in a task whatever the number of documents; a text
    longer than a chunk is a chunk by itself, more or less. A bucket holds the
    distinct pre-tokens of about ``bucket_bytes`` of text and takes chunks one by
    one. The ranks, a fixed table, travel with the task.
    """
    chunks, buckets = chunk_and_bucket_counts(docs, chunk_bytes, bucket_bytes)
    source = packed(docs, chunks)
    sent = _sent(source, pattern, buckets)
    names = _names(ranks) if decoded else None

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        one = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, n, blob = (batch.column(c)[row].as_py() for c in ("chunk", "n", "words"))
                ids = []
                for w in unpack_words(blob, n):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = array("i", one(w.decode("utf-8"))).tobytes()
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.int32, n) // 4
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": chunk, "n": n, "words": blob, "ids": pack_array(np.frombuffer(b"".join(ids), np.int32)),
                      "sizes": pack_array(sizes)}],
                    schema=pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("words", pa.binary()),
                                      ("ids", pa.binary()), ("sizes", pa.binary())]))
        del known
        give_back()

    @thrifty
    def assembled(left: pa.Table, right: pa.Table) -> pa.Table:
        import regex

        place: dict[str, int] = {}
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for row in range(right.num_rows):
            n, words, ids, size = (right[c][row].as_py() for c in ("n", "words", "ids", "sizes"))
            for w in unpack_words(words, n):
                place[w.decode("utf-8")] = len(place)
            flat.append(unpack_array(ids, np.int32))
            sizes.append(unpack_array(size, np.int32))
        flat, size = np.concatenate(flat), np.concatenate(sizes).astype(np.int64)
        begin = np.cumsum(size) - size
        cut, doc_ids, out, counts, spelled = regex.compile(pattern).findall, [], [], [0], []
        for doc_id, _, text in unpacked(left):
            at = np.fromiter(map(place.__getitem__, cut(text.decode("utf-8"))), np.int64)
            n = size[at]
            total = int(n.sum())
            where = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at], n)
            doc_ids.append(doc_id)
            out.append(flat[where])
            counts.append(counts[-1] + total)
            if names is not None:
                spelled.append(b"".join(map(names.__getitem__, out[-1].tolist())))
        ids = np.concatenate(out) if out else np.zeros(0, np.int32)
        columns = {"doc_id": pa.array(doc_ids, pa.int64()),
                   "ids": pa.ListArray.from_arrays(np.array(counts, np.int32), pa.array(ids, pa.int32()))}
        if names is not None:
            columns["decoded"] = pa.array(spelled, pa.binary())
        return pa.table(columns)

    answered = sent.groupBy("bucket").applyInArrow(
        encoded, "chunk long, n int, words binary, ids binary, sizes binary")
    return source.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(
        assembled, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def _names(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of each id."""
    names = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        names[rank] = token
    return names


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of an array of ids by lookup in the token table; NULL reads as empty.

    The table has one row per token of the vocabulary, whatever the documents.
    An id that it lacks fails.
    """
    names = _names(ranks)

    @F.arrow_udf("binary")
    @thrifty
    def decoded(column: pa.Array) -> pa.Array:
        lookup, parts = names.__getitem__, []
        for at in range(0, len(column), 256):
            part = column.slice(at, 256)
            flat = part.flatten().to_numpy(zero_copy_only=False)
            stops = np.cumsum(np.where(part.is_null(), 0, part.value_lengths().fill_null(0))).tolist()
            parts.append(pa.array([b"".join(map(lookup, flat[a:b].tolist()))
                                   for a, b in zip([0, *stops[:-1]], stops)], pa.binary()))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return decoded(ids)
