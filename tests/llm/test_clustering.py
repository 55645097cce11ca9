"""op11: the tree search and the whole clustering against brute force, and the defined cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from gridclime.llm import clustering
from gridclime.llm.queries import op11_clusters

SF_DIR = "/root/testdata/sf0.01"


def nearest(v, centroids):
    return min((clustering.squared(v, c), k) for k, c in enumerate(centroids))


def brute(rows, k=8, rounds=10, salt="3:"):
    """(id, cluster, distance) of rows (id, whole vector), and the centroids."""
    keyed = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [list(v) for _, v in keyed[:k]]
    for _ in range(rounds):
        at = [nearest(v, centroids)[1] for _, v in rows]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(rows, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, nearest(v, centroids)[1], nearest(v, centroids)[0]) for i, v in rows], centroids


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("spread", [1, 3, 400, 1 << 40])
def test_search_equals_brute_force_with_ties(seed, spread):
    rng = np.random.default_rng(seed)
    k, dims = int(rng.integers(1, 40)), int(rng.integers(1, 6))
    centroids = rng.integers(-spread, spread + 1, (k, dims)).tolist()
    vectors = rng.integers(-spread, spread + 1, (60, dims)).tolist()
    kind = np.int64 if spread < clustering.SAFE else object
    at, best = clustering.search(
        np.array(vectors, kind), np.array(centroids, kind), clustering.build_tree(centroids, leaf=int(rng.integers(1, 4)))
    )
    assert [(int(d), int(a)) for d, a in zip(best, at)] == [nearest(v, centroids) for v in vectors]


def test_search_leaves_far_regions_closed():
    centroids = [[x] for x in range(0, 6400, 100)]
    tree, seen = clustering.build_tree(centroids), []

    class Counted(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    at, _ = clustering.search(np.array([[3105]]), np.array(centroids), tree._replace(members=Counted(tree.members)))
    assert at.tolist() == [31] and len(seen) < len(tree.members) / 2


def test_whole_query_equals_brute_force(spark):
    got = op11_clusters(spark, SF_DIR).collect()
    source = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    rows = [
        (r.vec_id, [math.floor(1024 * float(x)) for x in r.embedding])
        for r in source
        if r.embedding is not None and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)
    ]
    want, centroids = brute(rows)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    assert {r.inertia for r in got} == {sum(d for _, _, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [-0.001, 5.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]),
        (8, [1.0, -inf]), (None, [0.3, 0.3]), (9, [7.0, 7.0]), (10, [1.0, 2.0, 3.0]),
    ]
    names = "vec_id long, embedding array<double>, cluster string, id string, vector string, n int, place int, hash int"
    df = spark.createDataFrame([(*r, "x", "y", "z", 1, 1, 1) for r in rows], names)
    found, _ = clustering.cluster(df, k=3, rounds=4, dims=2)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i in (1, 2, 9) or (i is None)]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted(brute(whole, 3, 4)[0], key=key)
    few, centroids = clustering.cluster(df.where("vec_id = 9"), k=3, dims=2)
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in few.collect()] == [(9, 0, 0, 0)] and centroids == [[7168, 7168]]
    none, centroids = clustering.cluster(df.where("false"), k=3, dims=2)
    assert none.collect() == [] and centroids == []


def test_components_beyond_a_long(spark):
    rows = [(1, [1e30]), (2, [-1e30]), (3, [2.0]), (4, [1e6])]
    found, _ = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, rounds=0, dims=1)
    got = {r.vec_id: (r.distance, r.inertia) for r in found.collect()}
    assert len(got) == 4 and any(d is None for d, _ in got.values()) and {i for _, i in got.values()} == {None}
    found, _ = clustering.cluster(spark.createDataFrame(rows[2:], "vec_id long, embedding array<double>"), k=1, rounds=3, dims=1)
    mean = (2048 + 1024_000_000) // 2
    assert {r.vec_id: r.distance for r in found.collect()} == {3: (2048 - mean) ** 2, 4: (1024_000_000 - mean) ** 2}
