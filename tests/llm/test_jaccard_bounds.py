"""op8: bounds that decide which sets are compared must never rule out a link."""

from __future__ import annotations

import numpy as np
import pytest

from gridclime.llm import jaccard_join as j


@pytest.mark.parametrize("seed", range(40))
def test_histograms_bound_what_is_common(seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.int64))
    a = np.sort(rng.choice(pool, rng.integers(1, 1500), replace=False))
    b = np.sort(rng.choice(pool, rng.integers(1, 1500), replace=False))
    if seed % 2:  # near copies of other sizes
        b = np.union1d(a[: rng.integers(0, len(a) + 1)], b[:50])
    u, v = (np.frombuffer(j.histogram(s), np.uint8) for s in (a, b))
    assert u.sum() == len(a) and len(u) * 2 > len(a) >= len(u) or len(a) < 2
    assert j.most_common(u, v) == j.most_common(v, u) >= len(np.intersect1d(a, b))


def test_histogram_that_overflows_says_nothing():
    assert j.histogram(np.arange(300, dtype=np.int64)) == b""
    assert len(j.histogram(np.array([5], np.int64))) == 2


def test_plausible_keeps_links_and_drops_strangers(spark):
    rng = np.random.default_rng(1)
    sets = {k: np.unique(rng.integers(0, 1 << 63, 400, dtype=np.int64)) for k in range(4)}
    sets[4] = np.union1d(sets[0][:360], sets[1][:10])
    sets[5] = np.arange(300, dtype=np.int64)  # no histogram
    marks = spark.createDataFrame([(k, bytearray(j.histogram(s))) for k, s in sets.items()], "point long, shingles binary")
    pairs = spark.createDataFrame([(0, 1), (0, 4), (2, 3), (1, 5), (4, 0)], "x long, y long")
    assert sorted(map(tuple, j.plausible(pairs, marks, 3, 4).collect())) == [(0, 4), (1, 5), (4, 0)]
