"""Operators that number, rank, look up and check without a second run of their input or an eager job."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridclime import quality
from gridclime.operators import delta, grouped, matching, ordered
from gridclime.sources import parameters, sinks


def jobs_of(spark, action):
    """Number of jobs that the action starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = action()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


def plan_of(df):
    """The plan as it was run in the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def parquet(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, n, rng.choice([0.0, -0.0, 1.5, -2.0, rng.gauss(0, 1e6), rng.random(), None])) for k in "ab" for n in range(700)]
    rows += [("hot", n, 5.0) for n in range(900)] + [("odd", n, v) for n, v in enumerate([math.inf, -math.inf, math.nan, 1e-300, None, 1e300])]
    spark.createDataFrame(rows, "k string, t int, v double").write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t"), rows


def test_ranks_start_no_job_and_equal_sorting(spark, parquet):
    df, rows = parquet
    curve, jobs = jobs_of(spark, lambda: ordered.duration_curve(df, "v", ["k"], ["t"]))
    assert jobs == 0
    got = {(r.k, r.t): r.counter for r in curve.collect()}
    for k in {r[0] for r in rows}:
        own = [(t, v) for name, t, v in rows if name == k]
        unknown = lambda v: v is None or math.isnan(v)
        own.sort(key=lambda r: (unknown(r[1]), 0.0 if unknown(r[1]) else -abs(r[1]), r[0]))
        assert [got[k, t] for t, _ in own] == list(range(1, len(own) + 1))


def test_five_numbers_start_no_job(spark, parquet):
    df, rows = parquet
    five, jobs = jobs_of(spark, lambda: grouped.five_number(df.where("k <> 'odd'"), "v", ["k"]))
    assert jobs == 0
    got = {r.k: r for r in five.collect()}
    for k in ("a", "b", "hot"):
        own = sorted(v for name, _, v in rows if name == k and v is not None)
        assert got[k].n == len(own)
        for name, p in grouped.FIVE.items():
            at = (len(own) - 1) * p
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - math.floor(at)))


def test_positions_read_their_input_once(parquet):
    df, rows = parquet
    placed = ordered.with_position(df, ["k"], ["t"])
    assert plan_of(placed).count("FileScan parquet") == 1
    assert {(r.k, r.t): (r.position, r.length) for r in placed.collect()} == {
        (k, t): (t + 1, sum(x == k for x, _, _ in rows)) for k, t, _ in rows
    }
    totals = ordered.running_total(df.where("k <> 'odd'"), "t", ["k"], ["t"], "c")
    assert plan_of(totals).count("FileScan parquet") == 1
    assert all(r.c == r.t * (r.t + 1) / 2 for r in totals.collect())


def test_buckets_of_texts_and_of_numbers_before_other_columns(spark):
    df = spark.createDataFrame([(n * 50 - 900, f"20{n % 90 + 10:02d}01{n % 28 + 1:02d}") for n in range(1600)], "n int, s string")
    buckets = sorted((r.n, r.b) for r in df.select("n", ordered.order_bucket(df, ["n", "s"]).alias("b")).collect())
    assert [b for _, b in buckets] == sorted(b for _, b in buckets) and len({b for _, b in buckets}) < 300
    placed = ordered.with_position(df, [], ["s", "n"], position="p", length="l").collect()
    order = sorted(((r.s, r.n) for r in placed))
    assert {(r.s, r.n): r.p for r in placed} == {key: i + 1 for i, key in enumerate(order)}


def test_row_before_the_last_is_repeated(spark):
    rows = [(k, p, n, p * 1.0) for k, n in (("a", 5), ("b", 1), ("c", 2)) for p in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k string, p int, n int, v double")
    got = sorted((r.k, r.p, r.v) for r in ordered.repeat_before_last(df, "p", "n").collect())
    assert got == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 4, 4), ("a", 5, 4), ("b", 1, 1), ("c", 1, 1), ("c", 2, 1)]


def test_last_value_takes_the_one_before(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in range(4)] + [("b", 0, 9.0)], "k string, t int, v double")
    got = sorted((r.k, r.t, r.v) for r in ordered.patch_last_with_previous(df, "v", ["k"], "t").collect())
    assert got == [("a", 0, 0), ("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("b", 0, 9)]


def test_grid_of_numbered_levels(spark):
    rows = [("S", "x", 1, 2.0), ("S", "y", 3, 1.0), ("T", "x", 1, None), (None, "z", 2, 4.0), ("T", None, 9, 4.0)]
    df = spark.createDataFrame(rows, "s string, k string, n int, v double")
    grid = matching.key_grid(df, ["s", "k", "n"])
    assert {tuple(r) for r in grid.collect()} == {(s, k, n) for s in "ST" for k in "xyz" for n in (1, 2, 3, 9)}
    assert grid.count() == 24 and "SinglePartition" not in plan_of(grid)
    kept = matching.key_grid(df, ["k", "s", "n"], {"n": [7, 8]}, keep=["s", "k"])
    assert sorted(tuple(r) for r in kept.collect()) == sorted((k, s, n) for s, k in (("S", "x"), ("S", "y"), ("T", "x")) for n in (7, 8))
    assert matching.key_grid(df.where("false"), ["s", "k"]).collect() == []
    dense = matching.densify(df, ["s", "k", "n"], {"v": 0.0})
    assert "SinglePartition" not in plan_of(dense) and dense.count() == 26
    assert {(r.s, r.k, r.n): r.v for r in dense.collect()}["T", "x", 1] == 0.0


def test_scenario_delta_takes_a_measures_baseline_from_the_baseline_row(spark):
    rows = [("B", 1, 3.0, 7.0, "b"), ("S", 1, 5.0, 99.0, "s"), ("S", 2, 1.0, 1.0, "s")]
    df = spark.createDataFrame(rows, "Scenario string, k int, v double, v_baseline double, note string")
    for how in ("left", "full"):
        got = {r.k: r for r in delta.scenario_delta(df, "B", ["k"], ["v"], how=how).collect()}
        assert (got[1].v_baseline, got[1].delta_v, got[1].note, got[1].note_baseline) == (3.0, 2.0, "s", "b")
        assert got[2].v_baseline is None and got[2].Baseline_Scenario is None
    again = delta.scenario_delta(delta.scenario_delta(df.union(df.where("Scenario = 'S' and k = 1").withColumn("Scenario", F.lit("T")).withColumn("v", F.lit(11.0))), "B", ["k"], ["v"]).drop("Baseline_Scenario"), "S", ["k"], ["v"])
    assert [(r.Scenario, r.v_baseline, r.delta_v) for r in again.collect()] == [("T", 5.0, 6.0)]


def test_full_delta_reads_once_and_gives_each_scenario_the_rows_it_lacks(spark, tmp_path):
    rows = [("B", 1, 1.0), ("B", 1, 2.0), ("B", None, 4.0), ("S", 1, 5.0), ("S", 3, 6.0), ("T", None, 7.0)]
    spark.createDataFrame(rows, "Scenario string, k int, v double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    full = delta.scenario_delta(df, "B", ["k"], ["v"], how="full", scenarios=["S", "T", "U"])
    assert plan_of(full).count("FileScan parquet") == 1 and "ubquery" not in plan_of(full)
    got = sorted(((r.Scenario, r.k, r.v, r.v_baseline) for r in full.collect()), key=repr)
    want = [("S", 1, 5.0, 1.0), ("S", 1, 5.0, 2.0), ("S", 3, 6.0, None), ("S", None, None, 4.0), ("T", 1, None, 1.0), ("T", 1, None, 2.0)]
    want += [("T", None, 7.0, 4.0), ("U", 1, None, 1.0), ("U", 1, None, 2.0), ("U", None, None, 4.0)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_range_lookup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    end = lambda: None if rng.random() < 0.2 else round(rng.uniform(-50, 50), rng.choice([0, 3]))
    ranges = [(i, end(), end()) for i in range(rng.choice([0, 1, 30]))]
    values = [(n, None if n == 7 else math.nan if n == 8 else rng.choice([rng.uniform(-80, 80), float(rng.randint(-50, 50))])) for n in range(300)]
    rows = spark.createDataFrame(values, "n int, v double")
    table = spark.createDataFrame(ranges, "id int, low double, high double")
    got = sorted((r.n, r.id) for r in matching.range_lookup(rows, "v", table, "low", "high", "inner").collect())
    want = sorted(
        (n, i) for n, v in values for i, a, b in ranges
        if v is not None and not math.isnan(v) and (a is None or a <= v) and (b is None or v <= b) and not (a is not None and b is not None and a > b)
    )
    assert got == want
    kept = matching.range_lookup(rows, "v", table, "low", "high")
    assert kept.columns == ["n", "v", "id", "low", "high"] and {r.n for r in kept.collect()} == set(range(300))
    assert "CartesianProduct" not in plan_of(kept) and "NestedLoop" not in plan_of(kept)


def test_scenario_names(spark):
    frame = parameters.scenario_dimension(spark, "base", climates=["x", "y"])
    assert parameters.scenario_names(frame, "Scenario") == [parameters.BASELINE, "x", "y"]
    assert parameters.scenario_names(["b", "a"]) == ["b", "a"]
    for wrong in (["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            parameters.scenario_names(wrong)
    rows = matching.per_scenario(spark.range(2), ["b", "a"]).collect()
    assert sorted((r.id, r.scenario) for r in rows) == [(0, "a"), (0, "b"), (1, "a"), (1, "b")]


def test_checks_run_inside_the_job_that_writes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, v string")
    marked = quality.mark_group_size(quality.mark_repeats(df, ["id"]), ["id"])
    metrics = {
        "n": F.count(F.lit(1)), "n_repeated": quality.n_where("_repeat"), "n_null": quality.n_where(F.col("v").isNull()),
        "n_pairs": quality.n_where("_group_size = 2"),
    }
    marks = ["_repeat", "_group_size"]
    table, found = sinks.rebuild_checked(marked, path, None, metrics, {"n": 3, "n_repeated": 1}, marks)
    assert found == {"n": 3, "n_repeated": 1, "n_null": 1, "n_pairs": 2} and table.columns == ["id", "v"]
    with pytest.raises(quality.CheckFailed, match="n_repeated is 1, not 0; n is 3, not 4"):
        sinks.rebuild_checked(marked, path, None, metrics, {"n_repeated": 0, "n": 4}, marks)
    assert sinks.versions(spark, path) == [1] and sinks.read_version(spark, path).count() == 3
    with pytest.raises(quality.CheckFailed):
        quality.require({}, {"n": 1})
