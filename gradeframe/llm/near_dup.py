"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets become one. Banded signatures propose pairs;
signatures are compared batch by batch, and a pair goes as soon as its
posterior probability of being similar is below the miss probability;
survivors are verified on full shingle sets. Pairs that are already in one
component are not looked at again, so a group of n near copies costs about n
comparisons instead of n squared: a few rounds link documents with the central
one of a bucket before whole buckets are compared.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import stored, thrifty
from gradeframe.llm.graph import components
from gradeframe.llm.textarrays import Words, mix64, slices

BANDS, ROWS = 32, 5  # a pair at similarity 0.8 shares no band with probability 3e-6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-6
BLOCK = 1024
ROUNDS = 2  # of links with central documents before all pairs; the result does not depend on it
SMALL_IDS = 2_000_000  # so many ids, 16 MB, may be broadcast


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and where each text begins.

    A text with fewer words than a shingle has one shingle, all its words.
    """
    h, n = words.hashes(), words.counts
    with np.errstate(over="ignore"):
        wide = h.copy()
        for k in range(1, size):
            follow = np.zeros_like(h)
            follow[:len(h) - k] = h[k:]
            wide = mix64(wide * np.uint64(3) + follow)
    inside = np.arange(len(h)) - words.first[words.doc]
    full = inside + size <= n[words.doc]
    short = np.flatnonzero((n > 0) & (n < size))
    whole = []
    for i in short:
        x = np.array([n[i]], np.uint64)
        with np.errstate(over="ignore"):
            for w in h[words.first[i]:words.first[i + 1]]:
                x = mix64(x * np.uint64(5) + w)
        whole.append(x[0])
    value = np.concatenate([wide[full], np.array(whole, np.uint64)])
    doc = np.concatenate([words.doc[full], short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(value: np.ndarray, first: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of each of ``HASHES`` functions over each text that has shingles."""
    out = np.zeros((len(filled), HASHES), np.uint16)
    if not len(filled):
        return out
    high, low = (value >> np.uint64(32)).astype(np.uint32), value.astype(np.uint32)
    factors = mix64(np.arange(2 * HASHES, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            mixed = high * factors[2 * j] + low * factors[2 * j + 1]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            out[:, j] = np.minimum.reduceat(mixed, first[filled]) & np.uint32(0xFFFF)
    return out


def sketch(text: Column, size: int) -> Column:
    """(n_shingles, key, signature) of a text; no key and signature without words.

    ``key`` identifies the shingle set by 128 bits.
    """

    @F.arrow_udf("n_shingles long, key binary, signature binary")
    @thrifty
    def sketched(column: pa.Array) -> pa.Array:
        counts, keys, signatures = [], [], []
        for words in slices(column, lower=True):
            value, first = shingles(words, size)
            n = np.diff(first)
            filled = np.flatnonzero(n)
            rows = _signatures(value, first, filled)
            with np.errstate(over="ignore"):
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(value ^ np.uint64(salt)))])
                        for salt in (1, 1 << 40)]
                two = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], 1)
            counts.append(n)
            own_key, own_sig = [None] * len(n), [None] * len(n)
            for r, i in enumerate(filled):
                own_key[i], own_sig[i] = two[i].tobytes(), rows[r].tobytes()
            keys += own_key
            signatures += own_sig
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
             pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
            ["n_shingles", "key", "signature"])

    return sketched(text)


def _bands(signature: Column) -> Column:
    @F.arrow_udf("array<long>")
    @thrifty
    def banded(column: pa.Array) -> pa.Array:
        sig = _matrix(column)
        with np.errstate(over="ignore"):
            out = np.zeros((len(sig), BANDS), np.uint64)
            for r in range(ROWS):
                out = mix64(out * np.uint64(3) + sig[:, r::ROWS]) + np.arange(BANDS, dtype=np.uint64)
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, BANDS, dtype=np.int32),
                                        out.astype(np.int64).ravel())

    return banded(signature)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def least_matches(threshold: float, miss: float) -> list[int]:
    """Matches a pair needs after each batch to stay.

    With a uniform prior the similarity after m matches of n has a Beta
    posterior; it exceeds the threshold with the probability that at most m of
    n + 1 trials succeed at the threshold.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _stay(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Rows of two signature matrices that no batch prunes."""
    at, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[at, part] == b[at, part]).sum(1)
        keep = matches >= need
        at, matches = at[keep], matches[keep]
    return at


def _unpruned(pairs: DataFrame, reps: DataFrame, least: list[int]) -> DataFrame:
    """Pairs (a, b) whose signatures pass all batches."""

    @F.arrow_udf("boolean")
    @thrifty
    def passed(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), bool)
        out[_stay(_matrix(left), _matrix(right), least)] = True
        return pa.array(out)

    return (pairs.join(reps.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(reps.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
            .where(passed("sa", "sb")).select("a", "b"))


def _sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Full shingle sets (doc_id, s) of the documents with these ids, ascending.

    The ids are broadcast if they are few, so that texts stay where they are.
    """

    @F.arrow_udf("array<long>")
    @thrifty
    def sets(column: pa.Array) -> pa.Array:
        out = []
        for words in slices(column, lower=True):
            value, first = shingles(words, size)
            out += [np.sort(value[a:b].view(np.int64)) for a, b in zip(first[:-1], first[1:])]
        return pa.array(out, pa.list_(pa.int64()))

    ids = stored(ids.distinct(), "ids")
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    return stored(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
                  .select("doc_id", sets(F.col("text")).alias("s")).dropDuplicates(["doc_id"]), "shingles")


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids whose full sets have ``100 * intersection >= percent * union``."""

    @F.arrow_udf("boolean")
    @thrifty
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for i in range(len(left)):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    full = _sets(pairs.select(F.col("a").alias("doc_id")).unionByName(
        pairs.select(F.col("b").alias("doc_id"))), docs, size)
    return (pairs.join(full.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(full.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
            .where(similar("sa", "sb")).select("a", "b"))


def _central(members: DataFrame, round_: int) -> DataFrame:
    """Each document with a central one of its buckets that is in another component.

    The first round takes the document that shares most buckets with others,
    later ones take one by hash. Of several, a document is paired with the one
    it shares most buckets with.
    """
    order = F.col("degree") if round_ == 0 else F.xxhash64("rep", F.lit(round_))
    centre = (members.groupBy("bucket").agg(
        F.max(F.struct(order.alias("order"), F.col("rep").alias("a"), F.col("component").alias("ca"))).alias("c"),
        F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket", "c.*"))
    return (members.join(centre, "bucket").where("component <> ca").groupBy("a", F.col("rep").alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("order"))
            .groupBy("b").agg(F.max(F.struct("n", "order", "a"))["a"].alias("a")).select("a", "b"))


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after each document takes that of the central one it is linked with, and of that label's own.

    They may be finer than components, which costs comparisons but loses none.
    A central document stands above those linked to it, so there are no circles.
    """
    taken = (labels.join(links.select(F.col("b").alias("rep"), "a"), "rep", "left")
             .withColumn("component", F.coalesce("a", "component")).drop("a"))
    above = taken.select(F.col("rep").alias("component"), F.col("component").alias("next"))
    return taken.join(above, "component", "left").select(
        "rep", "degree", F.coalesce("next", "component").alias("component"))


def _united(links: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select(F.col("a").alias("u"), F.col("b").alias("v")) for x in links])


def _facing(table: pa.Table, least: list[int]):
    """For each member of one block, the members of the other that no batch prunes.

    Members of one component don't face each other, and a pair does so in the
    first band that it shares only.
    """
    sig = _matrix(table["signature"])
    bands = sig.reshape(len(sig), BANDS, ROWS)
    rep, comp, own = (table[c].to_numpy() for c in ("rep", "component", "own"))
    i, j, band = (table[c][0].as_py() for c in ("i", "j", "band"))
    right = np.flatnonzero(own == j)
    for x in np.flatnonzero(own == i):
        y = right[(comp[right] != comp[x]) & ((rep[right] > rep[x]) | (i != j))]
        for k, need in enumerate(least):
            stop = (k + 1) * BATCH
            y = y[(sig[y, :stop] == sig[x, :stop]).sum(1) >= need]
        y = y[~(bands[y, :band] == bands[x, :band]).all(2).any(1)]
        if len(y):
            yield x, y


def _blocks(members: DataFrame) -> DataFrame:
    """Members of buckets dealt into the groups (bucket, i, j) in which their blocks i and j meet.

    Members of a bucket's largest component need not face each other, only the
    strays do face all. Both kinds are cut into blocks of about ``BLOCK``;
    strays' blocks come first, and each of them meets every block, in a group of
    its own. So a huge bucket is spread over many tasks, all of its pairs between
    components meet, and members of the largest component are copied only once
    per block of strays.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = sizes.groupBy("bucket").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("m"),
                                        F.sum("n").alias("all")).select(
        "bucket", "m.main", F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("strays"),
        F.ceil(F.col("m.n") / BLOCK).cast("int").alias("rest"))
    hashed = F.xxhash64("rep")
    stray = F.col("component") != F.col("main")
    return (members.join(mains, "bucket")
            .withColumn("own", F.when(stray, F.pmod(hashed, F.col("strays")))
                        .otherwise(F.col("strays") + F.pmod(hashed, F.col("rest"))).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(
                stray, F.col("strays") + F.col("rest")).otherwise(F.col("strays")) - 1)))
            .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    "band", "own", "rep", "component", "signature"))


def _across(members: DataFrame, docs: DataFrame, size: int, percent: int, least: list[int]) -> DataFrame:
    """Verified links (a, b) between components within buckets.

    ``members`` has bucket, band, rep, component and signature. A first pass
    over the groups of blocks finds the members that face another one; only
    these get their shingle sets for the second, which verifies pairs on the
    spot and leaves out those that its own links have joined. So what a group
    gives grows with its members, not with their pairs.
    """
    # Groups are heavy for their bytes, so they are not to be merged into few tasks.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(members).repartition(tasks, "bucket", "i", "j")

    @thrifty
    def screen(table: pa.Table) -> pa.Table:
        kept = np.zeros(table.num_rows, bool)
        for x, y in _facing(table, least):
            kept[x] = kept[y] = True
        return table.filter(pa.array(kept))

    @thrifty
    def link(table: pa.Table) -> pa.Table:
        rep, comp = table["rep"].to_numpy(), table["component"].to_numpy()
        sets = table["s"].combine_chunks()
        values, bounds = sets.values.to_numpy(), sets.offsets.to_numpy().astype(np.int64)
        parent: dict[int, int] = {}

        def root(c):
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        found = []
        for x, y in _facing(table, least):
            y = y[[root(comp[v]) != root(comp[x]) for v in y]]
            own, n = values[bounds[x]:bounds[x + 1]], bounds[y + 1] - bounds[y]
            if not len(y) or not len(own):
                continue
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[y], n)
            theirs = values[at]
            spot = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
            both = np.add.reduceat((own[spot] == theirs).astype(np.int64), np.cumsum(n) - n)
            for v in y[100 * both >= percent * (len(own) + n - both)]:
                if root(comp[v]) != root(comp[x]):
                    parent[root(comp[v])] = root(comp[x])
                    found.append((min(rep[x], rep[v]), max(rep[x], rep[v])))
        out = np.array(found, np.int64).reshape(-1, 2)
        return pa.table([out[:, 0], out[:, 1]], ["a", "b"])

    facing = stored(dealt.groupBy("bucket", "i", "j").applyInArrow(screen, dealt.schema), "facing")
    full = _sets(facing.select(F.col("rep").alias("doc_id")), docs, size)
    return (facing.join(full.withColumnRenamed("doc_id", "rep"), "rep").repartition(tasks, "bucket", "i", "j")
            .groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * intersection >= percent * union`` of
    their sets of distinct ``size``-word shingles; a component id is the
    smallest doc_id that links reach. A document with fewer words than a
    shingle has one shingle of all its words; without words it has none and is
    linked with nothing. A row without doc_id has no component and is kept.
    Repeated rows share a component and are kept or not together; ids stand for
    texts, so rows with one id should have one text. Other columns are ignored.

    ``miss`` is the probability at which the comparison of signatures may prune
    a similar pair. No link is accepted unverified.
    """
    least = least_matches(percent / 100, miss)
    rows = stored(docs.select("doc_id", sketch(F.col("text"), size).alias("s")).select("doc_id", "s.*"), "sketches")
    known = rows.where("key is not null and doc_id is not null")
    reps = stored(known.groupBy("key").agg(F.min("doc_id").alias("rep"),
                                           F.min_by("signature", "doc_id").alias("signature")), "sets")
    banded = reps.select("rep", F.posexplode(_bands(F.col("signature"))).alias("band", "bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(banded.join(sizes, "bucket").select("bucket", "band", "n", "rep"), "buckets")
    degrees = stored(shared.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")
    labels = degrees.withColumn("component", F.col("rep"))
    links = []
    for round_ in range(ROUNDS):
        central = stored(_central(shared.join(labels, "rep"), round_), "central")
        links.append(stored(verified(stored(_unpruned(central, reps, least), "pairs"), docs, size, percent), "links"))
        if round_ + 1 < ROUNDS:
            labels = stored(_relabelled(labels, links[-1]), "labels")
    joined = components(_united(links))
    known = degrees.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    members = shared.join(known, "rep")
    mixed = members.groupBy("bucket").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    apart = stored(members.join(mixed, "bucket", "left_semi"), "apart")
    if not apart.isEmpty():
        more = _across(apart.join(reps.select("rep", "signature"), "rep"), docs, size, percent, least)
        joined = components(_united([*links, more]))
    of_set = reps.select("key", "rep").join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component_id"))
    done = rows.select("doc_id", "n_shingles", "key").join(of_set, "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
