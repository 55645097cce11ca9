"""Exact integer k-means whose vectors search a vantage-point tree over the centroids, best region first.

Components become integers, so every distance, sum and mean is exact and the result does not depend on how the vectors
are partitioned. Each round builds the tree anew on the driver (its size is the number of centroids, a parameter),
broadcasts it, and lets every task search it for its vectors; only sums per centroid come back.

Defined cases: null, short, long or non-finite vectors are left out; an empty table gives no rows; a null id is kept and
never a first centroid; repeated rows count as often as they occur; equal hashes of first centroids are told apart by
the vectors themselves; with fewer vectors than centroids there are as many centroids as vectors. Components saturate at
the range of a long. A distance or sum that no long can hold is null. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Tables

#: Components below this keep squared distances of up to 256 components inside a long; larger ones use Python integers.
SAFE = 1 << 27
LEAF = 2
#: Components of vectors that a search holds at a time.
SEARCH_CELLS = 1 << 20
FAR = 1 << 62
LONGEST = (1 << 63) - 1


class Tree(NamedTuple):
    """Node i tests the centroids ``members[i]``; an inner node (a vantage point) has two children.

    ``child[i, s]`` is a node or -1, and ``low[i, s]``, ``high[i, s]`` are whole numbers between which all distances from
    the vantage point to the centroids below that child lie.
    """

    members: list[list[int]]
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) * (x - y) for x, y in zip(a, b))


def build_tree(centroids: list[list[int]], leaf: int = LEAF) -> Tree:
    """Vantage-point tree; the centroid farthest from the first of a node is its vantage point, halves are by rank."""
    members, child, low, high = [], [], [], []

    def node(own: list[int]) -> int:
        at = len(members)
        members.append(own)
        child.append([-1, -1])
        low.append([0, 0])
        high.append([0, 0])
        if len(own) <= leaf:
            return at
        vantage = max(own, key=lambda c: (squared(centroids[c], centroids[own[0]]), -c))
        rest = sorted((squared(centroids[c], centroids[vantage]), c) for c in own if c != vantage)
        members[at] = [vantage]
        half = (len(rest) + 1) // 2
        for side, part in enumerate((rest[:half], rest[half:])):
            if part:
                low[at][side] = math.isqrt(part[0][0])
                high[at][side] = math.isqrt(part[-1][0] - 1) + 1 if part[-1][0] else 0
                child[at][side] = node([c for _, c in part])
        return at

    if centroids:
        node(list(range(len(centroids))))
    kind = np.int64 if all(h < FAR for pair in high for h in pair) else object
    return Tree(members, np.array(child, np.int64).reshape(-1, 2), np.array(low, kind).reshape(-1, 2), np.array(high, kind).reshape(-1, 2))


def whole_root(x: np.ndarray) -> np.ndarray:
    """Floor of the square root of whole numbers, exact."""
    if x.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(x)
    s = np.sqrt(x.astype(np.float64)).astype(np.int64)
    s -= s * s > x
    s += (s + 1) * (s + 1) <= x
    return s


def search(vectors: np.ndarray, centroids: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and squared distance of each vector.

    All vectors advance together, but each has its own frontier: it opens its node of least lower bound and ends once
    that bound is beyond its best distance. A bound equal to the best distance is still opened (the pruning radius is
    inclusive), because a centroid of a smaller number may lie there. Bounds are whole numbers rounded down.
    """
    exact = object if centroids.dtype == object or vectors.dtype == object else np.int64
    far = FAR if exact is np.int64 else 1 << 200
    n = len(vectors)
    best, at = np.full(n, far, exact), np.full(n, -1, np.int64)
    reach = np.full(n, far, exact)  # floor of the root of best
    bounds, nodes = np.zeros((n, 1), exact), np.zeros((n, 1), np.int64)
    used = np.ones(n, np.int64)
    going = np.arange(n)
    while len(going):
        slot = bounds[going].argmin(axis=1)
        bound = bounds[going, slot]
        live = bound <= reach[going]
        going, slot, bound = going[live], slot[live], bound[live]
        opened = nodes[going, slot]
        bounds[going, slot] = far + 1
        for i in np.unique(opened).tolist():
            here = opened == i
            rows = going[here]
            for c in tree.members[i]:
                gap = vectors[rows] - centroids[c]
                d = (gap * gap).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (c < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], c
            reach[rows] = whole_root(best[rows])
            if tree.child[i, 0] < 0 and tree.child[i, 1] < 0:
                continue
            floor = whole_root(d)
            ceiling = floor + (floor * floor < d)
            slots = slot[here]
            for side in (0, 1):
                if tree.child[i, side] < 0:
                    continue
                least = np.maximum(np.maximum(bound[here], floor - tree.high[i, side]), tree.low[i, side] - ceiling)
                if side:  # the first child took the place of its parent
                    slots = used[rows]
                    used[rows] += 1
                    if slots.max() >= bounds.shape[1]:
                        more = slots.max() + 1 - bounds.shape[1]
                        bounds = np.hstack([bounds, np.full((n, more), far + 1, exact)])
                        nodes = np.hstack([nodes, np.zeros((n, more), np.int64)])
                bounds[rows, slots], nodes[rows, slots] = least, tree.child[i, side]
    return at, best


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, vector) of the usable vectors, each component x as floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where((F.size(v) == dims) & usable)
    return kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("vector"))


def _searched(batch: pa.RecordBatch, given) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, vectors, nearest, squared distance) of blocks of a batch of (id, vector)."""
    centroids, tree = given
    dims = len(centroids[0]) if centroids else 1
    flat = np.asarray(batch.column(1).flatten())
    vectors = flat.reshape(-1, dims) if len(flat) else np.zeros((0, dims), np.int64)
    rows = max(1, SEARCH_CELLS // dims)
    small = all(-SAFE < x < SAFE for c in centroids for x in c) and dims <= 256
    for first in range(0, len(vectors), rows):
        block = vectors[first : first + rows]
        kind = np.int64 if small and block.max() < SAFE and block.min() > -SAFE else object
        block = block.astype(kind)
        yield first, block, *search(block, np.array(centroids, kind), tree)


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of each row of (id, vector)."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast((centroids, tuple(build_tree(centroids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, tree = given.value
        for batch in batches:
            for first, block, at, best in _searched(batch, (centroids, Tree(*tree))):
                distance = pa.array([int(d) if d <= LONGEST else None for d in best], pa.int64())
                columns = [batch.column(0).slice(first, len(block)), pa.array(at.astype(np.int32)), distance]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    id_type = vectors.schema["id"].dataType
    out = T.StructType().add("id", id_type).add("cluster", "integer").add("distance", "long")
    return vectors.mapInArrow(run, out)


def means(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: floor of the exact mean of each centroid's vectors; those without vectors stay."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast((centroids, tuple(build_tree(centroids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, tree = given.value
        totals: dict[int, list] = {}
        for batch in batches:
            for _, block, at, _ in _searched(batch, (centroids, Tree(*tree))):
                for c in np.unique(at).tolist():
                    own = block[at == c]
                    n, sums = totals.get(c, (0, [0] * block.shape[1]))
                    totals[c] = (n + len(own), [a + int(b) for a, b in zip(sums, own.sum(axis=0))])
        for c, (n, sums) in totals.items():
            yield pa.RecordBatch.from_pydict(
                {
                    "cluster": pa.array([c] * len(sums), pa.int32()),
                    "place": pa.array(range(len(sums)), pa.int32()),
                    "n": pa.array([n] * len(sums), pa.int64()),
                    "total": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
                }
            )

    parts = vectors.mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    found = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    given.unpersist()
    new = [list(c) for c in centroids]
    for r in found:
        new[r.cluster][r.place] = int(r.total) // r.n
    return new


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``salt`` and id, in that order."""
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    order = vectors.where(F.col("id").isNotNull()).select(key.alias("key"), "vector").orderBy("key", "vector").limit(k)
    return [list(r.vector) for r in order.collect()]


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10,
    dims: int = 64, scale: int = 1024, salt: str = "3:",
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector, and the centroids.

    Rounds end early only where no centroid moved any more, as all further ones would repeat that round.
    """
    spark = df.sparkSession
    tables = Tables(spark, "clusters")
    vectors = tables.save(whole_vectors(df, id_col, vector_col, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, salt)
    for _ in range(rounds if centroids else 0):
        before, centroids = centroids, means(vectors, centroids)
        if centroids == before:
            break
    given = vectors if centroids else vectors.limit(0)
    placed = tables.save(assign(given, centroids), "placed")
    lost = F.max(F.col("distance").isNull()).alias("lost")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), lost).collect()
    tables.drop("vectors")

    def fitting(total, lost):
        return None if lost or total > LONGEST else int(total)

    whole = fitting(sum(r.total or 0 for r in sums), any(r.lost for r in sums))
    text = [",".join(map(str, c)) for c in centroids]
    rows = [(r.cluster, fitting(r.total or 0, r.lost), whole, hashlib.sha256(text[r.cluster].encode()).hexdigest()) for r in sums]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.withColumnRenamed("id", id_col).join(about, "cluster", "left")
    return out.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
