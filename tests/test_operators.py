"""General operators against brute force, hand-computed values and published results."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from gridclime import quality
from gridclime.functions import calendar, missing, recode
from gridclime.operators import delta, grouped, matching, ordered, reshape
from gridclime.plans import compare


def series(lengths, seed=1):
    rng = random.Random(seed)
    return [
        (k, 3 * i, None if rng.random() < 0.05 else rng.random()) for k, n in lengths.items() for i in range(n)
    ]


def brute_mean(rows, stride, half_width, include_last):
    out = {}
    for k in {r[0] for r in rows}:
        s = [r for r in rows if r[0] == k]
        last = len(s) if include_last else len(s) - 1
        for p in range(len(s)):
            at = [p + j * stride for j in range(-half_width, half_width + 1)]
            v = [s[i][2] for i in at if 0 <= i < last]
            out[k, s[p][1]] = None if not v or None in v else sum(v) / len(v)
    return out


@pytest.mark.parametrize("include_last", [True, False])
@pytest.mark.parametrize("stride,half_width,chunk", [(12, 5, 512), (7, 1, 3), (1, 2, 4)])
def test_strided_mean_matches_its_index_definition(spark, monkeypatch, include_last, stride, half_width, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rows = series({"a": 1, "b": 37, "c": 150, None: 80})
    df = spark.createDataFrame(rows, "k string, t int, v double")
    # a bucket of 20 numbers makes every longer series span several buckets
    placed = ordered.with_position(df, ["k"], ["t"], F.floor(F.col("t") / 20))
    got = ordered.strided_mean(
        placed, "v", ["k"], ["t"], stride, half_width, include_last, position="position", length="length"
    )
    expected = brute_mean(rows, stride, half_width, include_last)
    result = {(r.k, r.t): r.avg_v for r in got.collect()}
    assert result.keys() == expected.keys()
    for key, value in expected.items():
        assert result[key] == (value if value is None else pytest.approx(value, abs=1e-12))


def test_running_total_across_buckets_and_after_a_null(spark):
    rows = [("a", t, float(t)) for t in range(50)] + [("b", t, None if t == 7 else 1.0) for t in range(20)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = ordered.running_total(df, "v", ["k"], ["t"], "c", F.floor(F.col("t") / 4)).collect()
    got += ordered.running_total(df, "v", ["k"], ["t"], "c", few_rows=True).collect()
    for r in got:
        if r.k == "a":
            assert r.c == r.t * (r.t + 1) / 2
        else:
            assert r.c == (r.t + 1 if r.t < 7 else None)


def test_rank_and_quantiles_of_one_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot", i, float(rng.randint(0, 9))) for i in range(3000)] + [("cold", i, -float(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    curve = ordered.duration_curve(df, "v", ["k"], ["i"]).collect()
    for k in ("hot", "cold"):
        expected = sorted((r for r in rows if r[0] == k), key=lambda r: (-abs(r[2]), r[1]))
        got = sorted((r for r in curve if r.k == k), key=lambda r: r.counter)
        assert [r.counter for r in got] == list(range(1, len(expected) + 1))
        assert [r.i for r in got] == [e[1] for e in expected]
    five = {r.k: r for r in grouped.five_number(df, "v", ["k"]).collect()}
    exact = {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", [0.0, 0.25, 0.5, 0.75, 1.0]).alias("q")).collect()}
    for k, r in five.items():
        assert [r.minimum, r.lower_quartile, r.median, r.upper_quartile, r.maximum] == pytest.approx(exact[k])


def test_null_and_zero_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (3.0, 2.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in df.select(missing.r_div("a", "b")).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3:] == [None, 1.5, None]
    one = df.agg(missing.na_sum("a").alias("s"), missing.na_sum("a", True).alias("t"), missing.na_mean("a").alias("m")).first()
    assert (one.s, one.t, one.m) == (None, 4.0, None)
    texts = spark.createDataFrame([(".",), ("2.5",), (None,), ("x",)], "t string")
    assert [r[0] for r in texts.select(missing.number_or_zero("t")).collect()] == [0.0, 2.5, 0.0, 0.0]


DELTA = [("B", "x", 4.0), ("B", "y", 0.0), ("B", "gone", 1.0), ("S", "x", -5.0), ("S", "y", 0.0), ("S", "new", 2.0), ("T", "gone", 3.0)]


@pytest.mark.parametrize("mode,expected", [("plain", (-9.0, -2.25)), ("abs", (1.0, 0.25)), ("reversed", (9.0, 2.25))])
def test_scenario_delta_modes(spark, mode, expected):
    df = spark.createDataFrame(DELTA, "Scenario string, k string, v double")
    rows = {(r.Scenario, r.k): r for r in delta.scenario_delta(df, "B", ["k"], ["v"], mode).collect()}
    assert set(rows) == {("S", "x"), ("S", "y"), ("S", "new"), ("T", "gone")}
    assert (rows["S", "x"].delta_v, rows["S", "x"].v_perc_change_from_baseline) == expected
    assert math.isnan(rows["S", "y"].v_perc_change_from_baseline)
    assert rows["S", "new"].Baseline_Scenario is None and rows["S", "new"].delta_v is None


def test_scenario_delta_full_and_rollup(spark):
    df = spark.createDataFrame(DELTA, "Scenario string, k string, v double")
    full = {(r.Scenario, r.k): r.delta_v for r in delta.scenario_delta(df, "B", ["k"], ["v"], how="full").collect()}
    assert full == {
        ("S", "x"): -9.0, ("S", "y"): 0.0, ("S", "new"): None, ("S", "gone"): None,
        ("T", "x"): None, ("T", "y"): None, ("T", "gone"): 2.0,
    }
    left = delta.scenario_delta(df, "B", ["k"], ["v"])
    rolled = {r.Scenario: r for r in delta.rollup_delta(left, ["Scenario"], ["v"]).collect()}
    assert rolled["S"].delta_v is None and rolled["T"].delta_v == 2.0
    skipping = delta.rollup_delta(left, ["Scenario"], ["v"], skip_nulls=True)
    assert {r.Scenario: r.delta_v for r in skipping.collect()}["S"] == -7.0
    kept = delta.drop_undefined_change(left, "v_perc_change_from_baseline")
    assert sorted((r.Scenario, r.k) for r in kept.collect()) == [("S", "x"), ("T", "gone")]


# Published transmission results, (period, new scenario, new baseline, total scenario, total baseline)
# and (period, type, difference, change).
TX_IN = [
    (2030, 3694.215, 8720.105, 400829.16, 405855.1),
    (2035, 18298.346, 11557.78, 419127.271, 417412.89),
    (2040, 18631.43, 31145.3869, 437759.451, 448558.19),
    (2045, 18165.796, 13951.558, 455924.433, 462509.55),
    (2050, 20130.089, 18652.163, 476054.903, 481162.59),
]
TX_OUT = [
    (2050, "New Tx Capacity Built", 1477.926, 0.079),
    (2050, "Total Tx Nameplate Capacity", -5107.687, -0.011),
    (2035, "Cumulative New Tx Capacity Built", 1714.676, 0.085),
    (2040, "Cumulative New Tx Capacity Built", -10799.2809, -0.21),
    (2050, "Cumulative New Tx Capacity Built", -5107.1169, -0.061),
    (2030, "Existing Tx Capacity", -0.05, 0.0),
    (2040, "Existing Tx Capacity", 1715.2179, 0.004),
    (2050, "Existing Tx Capacity", -6585.613, -0.014),
]


def test_published_transmission_table(spark):
    rows = [("ACCESS-1.0", p, a, t) for p, a, _, t, _ in TX_IN] + [("Baseline no CC", p, b, t) for p, _, b, _, t in TX_IN]
    system = spark.createDataFrame(rows, "Scenario string, PERIOD int, BuildTx double, TxCapacityNameplate double")
    out = compare.tx_delta(compare.tx_long(compare.tx_balance(system))).collect()
    got = {(r.PERIOD, r.Tx_type): (r.Delta_MW_Tx, r.Tx_perc_change_from_baseline) for r in out}
    assert len(got) == 20
    for period, kind, difference, change in TX_OUT:
        assert got[period, kind][0] == pytest.approx(difference, abs=2e-4)
        assert got[period, kind][1] == pytest.approx(change, abs=1e-9)


def test_densify_and_grid(spark):
    df = spark.createDataFrame([("s", 1, "u", 2.0), ("t", 2, "v", float("nan"))], "a string, b int, c string, x double")
    dense = matching.densify(df, ["a", "b", "c"], {"x": 0.0})
    assert {(r.a, r.b, r.c): r.x for r in dense.collect() if r.x} == {("s", 1, "u"): 2.0}
    assert dense.count() == 8
    kept = matching.densify(df, ["a", "b", "c"], {"x": 0.0}, {"c": ["u", "w"]}, keep=["a", "b"])
    assert sorted((r.a, r.b, r.c) for r in kept.collect()) == [
        ("s", 1, "u"), ("s", 1, "w"), ("t", 2, "u"), ("t", 2, "v"), ("t", 2, "w"),
    ]


def test_match_pairs_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20), ("c", 30)], "k string, w int")
    full = {(r.k, r.v, r.w) for r in matching.match(left, right, ["k"], "full").collect()}
    assert full == {(None, 1, 10), ("a", 2, 20), ("b", 3, None), ("c", None, 30)}
    assert {r.v for r in matching.match(left, right, ["k"], "left_anti").collect()} == {3}
    totals = matching.with_total(left, "v", ["k"], "t", few_rows=True).collect()
    assert sorted(r.t for r in totals) == [1, 2, 3]


def test_recodes(spark):
    rows = [("Wind", "Battery_Storage", 2027), ("Bio_Gas", "x", 2028), ("ResidualFuelOil", "x", 2032), ("Waste_Heat", "CCGT", 2033), ("Gas", "Geothermal", 2053), ("Gas", "none", None)]
    df = spark.createDataFrame(rows, "s string, t string, y int")
    got = df.select(recode.normalise_source("s", "t"), recode.bin_period("y"), recode.technology_group("t")).collect()
    assert [tuple(r) for r in got] == [
        ("Battery Storage", "pre-2030", "Storage"),
        ("Biomass", "2030", None),
        ("Oil", "2030", None),
        ("Waste Heat", "2035", "Thermal"),
        ("Gas", "2055", "Geothermal"),
        ("Gas", None, None),
    ]
    zones = spark.createDataFrame([("CAN_BC",), ("CA_SCE",), ("WA_E",), ("MT_W",)], "z string")
    state = recode.state_of_zone("z")
    assert [tuple(r) for r in zones.select(state, recode.region_of(state), recode.is_us_zone("z")).collect()] == [
        ("CAN", "CAN", False), ("CA", "SW", True), ("WA", "PacNW", True), ("MT", "MT", True),
    ]


def test_calendar(spark):
    df = spark.createDataFrame([("2030070700",), ("2030010723",)], "timestamp string")
    parts = calendar.with_compact_parts(df).withColumn("h", calendar.local_hour("date_time_UTC"))
    assert [(r.Year, r.Month, r.Day, r.Hour_UTC, r.h) for r in parts.collect()] == [(2030, 7, 7, 0, 18), (2030, 1, 7, 23, 16)]
    days = spark.createDataFrame([(2024, 2), (2023, 2), (2023, 12)], "y int, m int")
    assert [r[0] for r in days.select(calendar.days_in_month(F.col("y"), "m")).collect()] == [29, 28, 31]
    hours = spark.range(1, 25).select(calendar.hour_bin("id").alias("b"))
    assert [r.b for r in hours.collect()] == [b for b in (4, 8, 12, 16, 20, 24) for _ in range(4)]


def test_reshape_and_fit(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], "k string, c string, v double")
    wide = reshape.pivot_fill(df, ["k"], "c", "v", ["x", "y"])
    assert sorted(map(tuple, wide.collect())) == [("a", 1.0, 2.0), ("b", 3.0, 0.0)]
    assert reshape.pivot_fill(df, ["k"], "c", "v", ["x", "y"], fill=None).where("y is null").count() == 1
    assert reshape.to_long(wide, ["k"], None, "c", "v").count() == 4
    line = spark.createDataFrame([("g", float(i), 2.0 * i + 1) for i in range(5)], "g string, x double, y double")
    fit = grouped.group_fit(line, "y", "x", ["g"]).first()
    assert (fit.r2, fit.slope, fit.intercept) == (pytest.approx(1), pytest.approx(2), pytest.approx(1))


def test_quality(spark):
    df = spark.createDataFrame([(1, 2.0), (1, None), (2, -1.0)], "k int, v double")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert quality.group_counts(df, ["k"], expected=2).first().k == 2
    assert tuple(quality.dropped_for_nulls(df, ["v"]).first()) == (3, 2, 1)
    assert quality.negative_demand(df, "v").count() == 1


def test_five_number_counts_equal_values_once(spark):
    values = [7.0] * 900 + [float(v) for v in range(100)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in grouped.five_number(df, "v", ["g"]).collect()}
    ordered_values = sorted(values)

    def quantile(p):
        at = p * (len(values) - 1)
        low = ordered_values[int(at)]
        return low + (ordered_values[min(int(at) + 1, len(values) - 1)] - low) * (at - int(at))

    assert got == {"a": (1000, *[quantile(p) for p in grouped.FIVE.values()]), "b": (1, 1.0, 1.0, 1.0, 1.0, 1.0)}


def test_scenario_delta_keeps_duplicate_baseline_rows_and_other_columns(spark):
    df = spark.createDataFrame(
        [("S", 1, 8.0, "x"), ("S", 2, 9.0, "y"), ("base", 1, 5.0, "p"), ("base", 1, 6.0, None)],
        "Scenario string, k int, v double, note string",
    )
    for how in ("left", "full"):
        got = delta.scenario_delta(df, "base", ["k"], ["v"], how=how)
        rows = got.select("k", "v_baseline", "delta_v", "note_baseline").collect()
        assert sorted(map(tuple, rows), key=repr) == [(1, 5.0, 3.0, "p"), (1, 6.0, 2.0, None), (2, None, None, None)]


def test_year_and_month_series_are_cut_by_year(spark):
    df = spark.range(240).selectExpr("cast(2000 + id div 12 as int) AS Year", "cast(id % 12 + 1 as int) AS Month")
    assert df.select(ordered.order_bucket(df, ["Year", "Month"])).distinct().count() == 20
