"""Packing documents into few sequences of bounded length.

Only the lengths decide who goes with whom, and there are at most ``capacity``
of them, so the packing is worked out on the histogram of lengths: how many
sequences hold which lengths. First sets that provably dominate all other
sets with their largest piece are fixed, as often as they occur, which shrinks
the instance; the rest goes best-fit, largest first. Every piece then finds its
sequence from its number among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.common import stored

CAPACITY = 1024
_SLICE_BYTES = 2 << 20
_PIECES = "doc_id long, piece int, start long, length int, ids array<int>, lane int, nth long"


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(0x100 + i): b for i, b in enumerate(hidden)}}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level BPE in a ``tokenizers`` file.

    Merges must be in the order of their results' ids, so that ids are ranks.
    """
    with open(path, encoding="utf-8") as file:
        spelled = json.load(file)
    model, byte = spelled["model"], _byte_of()
    added = {token["content"] for token in spelled["added_tokens"]}
    ids = model["vocab"]
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError("the ids of merged tokens do not follow the order of merges")
    return {bytes(byte[c] for c in token): i for token, i in ids.items() if token not in added}


def encoder(path: str, pattern: str):
    """A function from a text to its ids, as an array, for use inside a task.

    The ids are those of the ``tokenizers`` library without special tokens,
    whose strings are ordinary text. Its tokens and merges run in tiktoken, some
    three times as fast; very long blank runs, for which that has no stack,
    go through ``tokenizers`` itself.
    """
    ranks = read_vocabulary(path)
    with open(path, encoding="utf-8") as file:
        spelled = file.read()
    made: dict = {}

    def encode(text: str) -> np.ndarray:
        if "quick" not in made:
            import tiktoken

            made["quick"] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            made["blank"] = re.compile(r"\s{10000}")
        if len(text) >= 10000 and made["blank"].search(text):
            if "whole" not in made:
                from tokenizers import Tokenizer

                made["whole"] = Tokenizer.from_str(spelled)
                made["whole"].encode_special_tokens = True
            return np.array(made["whole"].encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(made["quick"].encode_ordinary(text), np.int32)

    return encode


@dataclass
class Plan:
    """Sequences of the same lengths in groups: (copies, ((length, how many), ...)); ``fixed`` of them by dominance."""

    capacity: int
    groups: list[tuple[int, tuple[tuple[int, int], ...]]] = field(default_factory=list)
    fixed: int = 0

    @property
    def sequences(self) -> int:
        return sum(copies for copies, _ in self.groups)

    def slots(self) -> dict[str, np.ndarray]:
        """Where the pieces of each length go, ordered by length and number.

        Pieces number ``first`` and on of a length go to sequences from ``sequence`` on, ``each`` into one, from ``offset`` on.
        """
        rows, taken, sequence = [], Counter(), 0
        for copies, held in self.groups:
            offset = 0
            for length, each in held:
                rows.append((length, taken[length], sequence, each, offset))
                taken[length] += copies * each
                offset += length * each
            sequence += copies
        rows.sort()
        return dict(zip(("length", "first", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def _take(counts: np.ndarray, plan: Plan, *lengths: int) -> None:
    """Fix a set of lengths as often as there are pieces for it."""
    need = Counter(lengths)
    copies = int(min(counts[length] // n for length, n in need.items()))
    for length, n in need.items():
        counts[length] -= copies * n
    plan.groups.append((copies, tuple(need.items())))


def reduce(counts: np.ndarray, plan: Plan) -> None:
    """Fix sets by dominance until none is left to fix; ``counts`` by length shrink.

    A set with piece ``j`` dominates another one with it if the other's pieces can be
    parted so that each part fits into the place of a piece of the set; then some best
    packing has the set. With the largest piece that fits beside ``j`` that holds:

    - if nothing fits beside ``j``, for ``j`` alone;
    - if it fills the sequence, or no two pieces fit beside ``j``;
    - if at most two fit, and no two together are longer than it;
    - with the longest that fits beside both: if at most two fit beside ``j``, and all
      two of which the smaller is longer than that one are together no longer than the largest.

    Taking pieces away leaves all that true, so a set is fixed as long as its pieces last.
    """
    before = None
    while before != plan.sequences:
        before = plan.sequences
        for j in range(plan.capacity, 0, -1):
            while counts[j] > 0 and _fix(counts, plan, j):
                pass
    plan.fixed = plan.sequences


def _fix(counts: np.ndarray, plan: Plan, j: int) -> bool:
    room = plan.capacity - j
    counts[j] -= 1
    some = np.flatnonzero(counts[:room + 1])
    few = np.minimum(counts[some], 3)
    counts[j] += 1
    if not len(some):
        _take(counts, plan, j)
        return True
    largest = int(some[-1])
    smallest = np.repeat(some[:3], few[:3])
    if largest == room or smallest[:2].sum() > room or len(smallest) < 2:
        _take(counts, plan, j, largest)
        return True
    if len(smallest) > 2 and smallest[:3].sum() <= room:
        return False  # three more may fit

    def longest_two(above: int) -> int:
        """Length of the longest two that fit, the smaller longer than ``above``; 0 if there are none."""
        most = 0
        for a, n in zip(some[some > above].tolist(), few[some > above]):
            beside = some[(some <= room - a) & (some >= a)]
            if len(beside) and beside[-1] == a and n < 2:
                beside = beside[:-1]
            if len(beside):
                most = max(most, a + int(beside[-1]))
        return most

    if longest_two(0) <= largest:
        _take(counts, plan, j, largest)
        return True
    beside = some[some <= room - largest]
    if len(beside) and beside[-1] == largest and few[-1] < 2:
        beside = beside[:-1]
    if not len(beside) or longest_two(int(beside[-1])) > largest:
        return False
    _take(counts, plan, j, largest, int(beside[-1]))
    return True


def best_fit(counts: np.ndarray, plan: Plan) -> None:
    """Largest first, each piece into the fullest sequence that has room; equal pieces and equal sequences at once."""
    room: dict[int, list] = {}

    def put(left: int, copies: int, held: tuple) -> None:
        if copies:
            room.setdefault(left, []).append((copies, held))

    for length in range(plan.capacity, 0, -1):
        n = int(counts[length])
        while n:
            left = min((r for r in room if r >= length), default=plan.capacity)
            if left in room:
                copies, held = room[left].pop()
                if not room[left]:
                    del room[left]
            else:
                copies, held = n, ()
            each = left // length
            full = min(copies, n // each)
            put(left - each * length, full, (*held, (length, each)))
            n -= full * each
            rest = 0
            if copies > full and n:
                rest = n  # less than one sequence takes
                put(left - rest * length, 1, (*held, (length, rest)))
                n = 0
            if held:
                put(left, copies - full - (rest > 0), held)
        counts[length] = 0
    plan.groups += [group for groups in room.values() for group in groups]


def plan_lengths(counts: np.ndarray, capacity: int = CAPACITY, dominance: bool = True) -> Plan:
    """The packing of ``counts[length]`` pieces of each length."""
    counts, plan = counts.copy(), Plan(capacity)
    if dominance:
        reduce(counts, plan)
    best_fit(counts, plan)
    return plan


def cut(docs: DataFrame, encode, end: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids, and ``lane`` and ``nth``.

    A document is its ids and ``end``. One longer than ``capacity`` is cut into
    pieces of that length, the first of which may be shorter. ``nth`` numbers the
    pieces of one length in one task, the lane.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces(batches):
        lane, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            step = max(1, whole.num_rows * _SLICE_BYTES // max(whole.nbytes, 1))
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                ids = [np.append(encode(t), np.int32(end)) for t in batch.column("text").to_pylist()]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(ids)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                first = (sizes - (number - 1) * capacity)[doc]
                length = np.where(piece == 0, first, capacity)
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                order = np.argsort(length, kind="stable")
                begin = np.flatnonzero(np.diff(length[order], prepend=-1))
                run = np.diff(np.append(begin, len(order)))
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(begin, run) + seen[length[order]]
                seen[length[order][begin]] += run
                edges = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                    pa.array(length, pa.int32()),
                    pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids), pa.int32())),
                    pa.array(np.full(len(doc), lane), pa.int32()), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids", "lane", "nth"])
                del ids
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(pieces, _PIECES)


def _placed(plan: Plan, length: Column, number: Column) -> Column:
    """(sequence_id, offset) of the piece with this number among those of its length."""
    slots = plan.slots()
    # Numbers past the first of a length's last slot belong to that slot.
    wide = int(slots["first"].max(initial=0)) + 1
    keys = slots["length"] * wide + slots["first"]

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        own, i = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (lengths, numbers))
        at = np.searchsorted(keys, own * wide + np.minimum(i, wide - 1), side="right") - 1
        past = i - slots["first"][at]
        return pa.StructArray.from_arrays(
            [pa.array(slots["sequence"][at] + past // slots["each"][at]),
             pa.array(slots["offset"][at] + past % slots["each"][at] * own)], names=["sequence_id", "offset"])

    return place(length, number)


def pack(docs: DataFrame, encode, end: int, capacity: int = CAPACITY, text: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids, sequence_id and offset.

    A sequence holds at most ``capacity`` ids, from offset 0 without gaps. A NULL
    text is empty and gives the end alone. Repeated rows and rows without id are
    documents of their own; other columns are ignored; no documents, no pieces.

    Texts are encoded once and the pieces written. The driver sees the histogram
    of lengths, ``capacity`` numbers, and the plan has a few groups per length,
    whatever the number of documents. A piece's number among all of its length is
    its number in its task and the sum over the tasks before, one row per task
    and length.
    """
    pieces = stored(cut(docs, encode, end, capacity, text), "pieces")
    lanes = stored(pieces.groupBy("lane", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    plan = plan_lengths(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    before = lanes.select("lane", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    numbered = pieces.join(before, ["lane", "length"]).withColumn(
        "_place", _placed(plan, F.col("length"), F.col("_before") + F.col("nth")))
    return numbered.select("doc_id", "piece", "start", "length", "ids", "_place.sequence_id", "_place.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids, and the documents with the lengths of their pieces, in order."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece", "length")))
    return placed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"),
        F.col("held.piece").alias("pieces"), F.col("held.length").alias("lengths"))


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian 32-bit numbers."""
    @F.arrow_udf("bigint")
    def crc(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        stops = np.cumsum(np.diff(column.offsets.to_numpy())) * 4
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())], pa.int64())

    return crc(ids)
