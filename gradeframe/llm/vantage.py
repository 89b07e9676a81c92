"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Every round builds the tree anew from the centroids and broadcasts it. A vector
walks it best first: the subtree with the least lower bound comes next, and
subtrees whose bound is beyond the best distance so far are left out; equal is
not beyond, because a smaller number may be in there. Bounds are doubles,
widened by more than their rounding; distances are exact integers.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.common import stored
from gradeframe.llm.vectors import finite

LEAF = 2
_SLACK = 2.0 ** -48
_CELLS = 1 << 21  # numbers that a block of vectors may take


@dataclass
class Tree:
    """``points``: centroids. Node i has ``members[i]`` (a leaf's, or the vantage point alone) and ``children[i]``,
    each as (node, least, greatest distance of its centroids from the vantage point)."""

    points: np.ndarray
    members: list[np.ndarray]
    children: list[list[tuple[int, float, float]]]

    def parts(self) -> tuple:
        """What a broadcast carries; executors need no copy of this class."""
        return self.points, self.members, self.children


def _squares(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = x - point
    return np.einsum("ij,ij->i", apart, apart)


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree over the rows of ``points``, integers; the median distance parts the inner half from the outer one."""
    tree = Tree(points, [], [])

    def grow(numbers: np.ndarray) -> int:
        node = len(tree.members)
        tree.members.append(numbers)
        tree.children.append([])
        if len(numbers) <= leaf:
            return node
        # Of a few candidates the one that spreads the others most.
        spread = [np.std(np.sqrt(_squares(points[numbers], points[c]).astype(float))) for c in numbers[:8]]
        vantage = int(np.argmax(spread))
        others = np.delete(numbers, vantage)
        away = _squares(points[others], points[numbers[vantage]])
        radius = np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2]
        inner = away <= radius
        if inner.all() and len(numbers) > 1 and away.min() == away.max():
            return node  # all equally far: nothing to part
        tree.members[node] = numbers[vantage:vantage + 1]
        for side in (inner, ~inner):
            if side.any():
                far = np.sqrt(away[side].astype(float))
                tree.children[node].append((grow(others[side]), float(far.min()), float(far.max())))
        return node

    if len(points):
        grow(np.arange(len(points)))
    return tree


def assign(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row of integers, ties to the smaller number, and its squared distance."""
    rows = max(64, _CELLS // (len(tree.members) + 4 * x.shape[1] + 1))
    parts = [_assign(x[at:at + rows], tree) for at in range(0, len(x), rows)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _assign(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    open_ = np.full((len(x), len(tree.members)), np.inf)  # lower bounds of the subtrees that a vector may still enter
    open_[:, 0] = 0.0
    best = np.full(len(x), np.iinfo(np.int64).max)
    number = np.full(len(x), len(tree.points))
    reach = np.full(len(x), np.finfo(float).max)
    active = np.arange(len(x))
    while len(active):
        bounds = open_[active]
        node = bounds.argmin(1)
        enters = bounds[np.arange(len(active)), node] <= reach[active]
        active, node = active[enters], node[enters]
        open_[active, node] = np.inf
        for v in np.unique(node):
            at = active[node == v]
            mine = x[at]
            for c in tree.members[v]:
                away = _squares(mine, tree.points[c])
                nearer = (away < best[at]) | ((away == best[at]) & (c < number[at]))
                best[at[nearer]], number[at[nearer]] = away[nearer], c
            reach[at] = np.sqrt(best[at].astype(float)) * (1 + _SLACK)
            if tree.children[v]:
                from_here = np.sqrt(away.astype(float))
                for child, least, greatest in tree.children[v]:
                    bound = np.maximum(from_here - greatest, least - from_here)
                    open_[at, child] = np.maximum(bound - _SLACK * (from_here + greatest), 0.0)
    return number, best


def whole(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, x) of vectors with ``width`` finite components, each the floor of ``scale`` times it.

    Components so large that a squared distance could leave 64 bits take a vector out as well.
    """
    most = 2.0 ** ((60 - (width - 1).bit_length()) // 2)
    kept = (F.size("embedding") == width) & finite(F.col("embedding"))
    scaled = F.transform("embedding", lambda c: c.cast("double") * float(scale))
    rows = vectors.where(kept).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    return rows.where(F.forall("x", lambda c: F.abs(c) < most)).select(
        "vec_id", F.transform("x", lambda c: F.floor(c).cast("int")).alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed and id; equal digests by the vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    taken = rows.select(digest.alias("digest"), "x").orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in taken], np.int64)


def _sums(rows: DataFrame, tree, k: int, width: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, component) to the sum of its vectors and their number; a task sends k x width sums."""
    def add(batches):
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            number, _ = assign(x, Tree(*tree.value))
            order = np.argsort(number, kind="stable")
            edges = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(edges):
                total[number[order][edges]] += np.add.reduceat(x[order], edges, axis=0)
            count += np.bincount(number, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))),
             pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))],
            ["cluster", "component", "total", "n"])

    sums = rows.select("x").mapInArrow(add, "cluster long, component long, total long, n long").groupBy(
        "cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    return {(r["cluster"], r["component"]): (int(r["total"]), r["n"]) for r in sums.collect()}


def cluster(vectors: DataFrame, k: int = 8, width: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3,
            leaf: int = LEAF) -> tuple[DataFrame, np.ndarray]:
    """Nearest centroid of every usable vector after ``rounds`` rounds, and the centroids.

    Gives (vec_id, cluster, distance), written to the shared folder, and a
    matrix of integers with at most k rows. Centroids start as the vectors
    with the smallest digests of ids; a round moves each to the floor of the
    mean of its vectors, an empty one stays. Sums are exact. Rows without id
    take part under an empty id; repeated rows count each; vectors of another
    width, NULL, or with NULL or non-finite components take no part. Without
    usable vectors the result is empty.

    Per round the driver gets k x ``width`` sums and sends as many numbers.
    Vectors are written once, as integers, and read by every round.
    """
    rows = stored(whole(vectors, width, scale), "integers")
    context = rows.sparkSession.sparkContext
    points = first_centroids(rows, k, seed).reshape(-1, width)
    for _ in range(rounds if len(points) else 0):
        tree = context.broadcast(build(points, leaf).parts())
        moved = points.copy()
        for (c, component), (total, n) in _sums(rows, tree, len(points), width).items():
            moved[c, component] = total // n
        tree.unpersist()
        points = moved
    tree = context.broadcast(build(points, leaf).parts())

    def nearest(batches):
        for batch in batches:
            number, away = assign(_matrix(batch.column("x"), width), Tree(*tree.value))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(away)],
                                             ["vec_id", "cluster", "distance"])

    done = stored(rows.mapInArrow(nearest, "vec_id long, cluster int, distance long"), "clusters")
    tree.unpersist()
    return done, points


def digest(point: np.ndarray) -> str:
    """SHA-256 of a centroid's components as decimal numbers."""
    return hashlib.sha256(",".join(map(str, point.tolist())).encode()).hexdigest()


def described(assigned: DataFrame, points: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (NULL beyond 64 bits) and centroid_sha256; one row per cluster is broadcast."""
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    table = assigned.sparkSession.createDataFrame(
        [(c, fits(d), fits(sum(sums.values())), digest(points[c])) for c, d in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")
