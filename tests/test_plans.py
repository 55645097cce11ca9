"""Domain pipelines on small hand-made inputs with their edge rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridclime.functions.recode import Period
from gridclime.plans import compare, degree_days, hydro, sampling, water_load
from gridclime.sources.parameters import COMBINED_FAMILY, COOLING_FAMILY, WATER_FAMILY

HOURS = "run string, timestamp_utc timestamp_ntz, raw_timepoint_id int, demand_mw double"


def test_degree_days_at_and_around_the_base(spark):
    df = spark.createDataFrame([(0.0, 10.0), (20.0, 30.0), (18.33, 18.34)], "Tmin double, Tmax double")
    got = [(r.HDD, r.CDD) for r in degree_days.degree_days(df).collect()]
    assert got[0] == (13.33, 0.0) and got[1] == (0.0, 6.67) and got[2][0] == 0.0


def test_climatology_delta_and_missing_day(spark):
    days = [dt.date(1980, 2, 28), dt.date(1984, 2, 28), dt.date(1984, 2, 29), dt.date(2011, 2, 28)]
    history = spark.createDataFrame([("Z", d, 10.0, float(n)) for n, d in enumerate(days)], "load_zone string, Date date, HDD double, CDD double")
    clim = degree_days.climatology(history)
    got = {(r.month, r.day, r.degree_day_type): r.hist_avg_degree_day_C for r in clim.collect()}
    assert got == {(2, 28, "HDD"): 10, (2, 28, "CDD"): 0.5, (2, 29, "HDD"): 10, (2, 29, "CDD"): 2}
    future = spark.createDataFrame([("S", "Z", dt.date(2030, 2, 28), 8.0, 1.0), ("S", "Z", dt.date(2030, 3, 1), 8.0, 1.0), ("S", "Z", dt.date(2071, 2, 28), 8.0, 1.0)], "Scenario string, load_zone string, Date date, HDD double, CDD double")
    delta = {(r.month, r.degree_day_type): r.delta_degree_day_C for r in degree_days.climatology_delta(future, clim).collect()}
    assert delta == {(2, "HDD"): -2.0, (2, "CDD"): 0.5, (3, "HDD"): None, (3, "CDD"): None}


def test_bands_wrap_and_never_match(spark):
    bands = spark.createDataFrame(
        [(1, 22, 6, 10, 2), (2, 6, 22, 3, 9), (3, 0, 24, None, 12), (4, 5, 5, 1, 12), (5, 0, 24, 7, 7)],
        "timeslice_id int, hour_of_day_start int, hour_of_day_end int, month_start int, month_end int",
    )
    counts = {r.timeslice_id: r["count"] for r in degree_days.expand_bands(bands).groupBy("timeslice_id").count().collect()}
    assert counts == {1: 8 * 5, 2: 16 * 7}
    stamps = [dt.datetime(2030, 3, 1, 7), dt.datetime(2030, 3, 1, 8), dt.datetime(2030, 7, 1, 14)]
    points = spark.createDataFrame([(n, t) for n, t in enumerate(stamps)], "raw_timepoint_id int, timestamp_utc timestamp_ntz")
    mapped = {(r.raw_timepoint_id, r.timeslice_id) for r in degree_days.band_map(points, bands).collect()}
    # 07:00 UTC on 1 March is still February in local standard time; 08:00 UTC is midnight of 1 March
    assert mapped == {(0, 1), (2, 2)}


def test_peak_and_median_ties(spark):
    rows = []
    for day, loads in {1: (5, 9), 2: (9, 1), 3: (6, 6), 4: (2, 2)}.items():
        rows += [("r", dt.datetime(2030, 2, day, h), day * 24 + h, float(v)) for h, v in enumerate(loads)]
    hourly = spark.createDataFrame(rows, HOURS)
    assert sampling.peak_days(hourly, ["run"]).first().date == dt.date(2030, 2, 1)
    # daily means 7, 5, 6, 2: the median 5.5 is equally near to days 2 and 3
    assert sampling.median_days(hourly, ["run"]).first().date == dt.date(2030, 2, 2)


def test_sample_weights_cover_the_year(spark):
    start = dt.datetime(2032, 1, 1)
    rows = [("r", start + dt.timedelta(hours=h), h, float((h * 37) % 101)) for h in range(366 * 24)]
    hourly = spark.createDataFrame(rows, HOURS)
    periods = [Period("2032", 2030, 2034)]
    for delta_t in (1, 4):
        sampled = sampling.sampled_hours(hourly, periods, delta_t, ["run"])
        weighted = sampling.sample_weights(sampled, periods, ["run"])
        series = sampling.sampled_timeseries(weighted, 1, 2, ["run"])
        ids = [r.sampled_timeseries_id for r in series.orderBy("sampled_timeseries_id").collect()]
        assert ids == list(range(24))
        total = series.agg(F.sum(F.col("scaling_to_period") * F.col("num_timepoints") / 5)).first()[0]
        assert total == pytest.approx(366 * 24)
        points = sampling.sampled_timepoints(weighted, series, ["run"])
        assert points.count() == 12 * 24 + 12 * 24 // delta_t


def test_hydro_ratio_rules_and_fallback(spark):
    months = [(y, m) for y in range(2025, 2031) for m in (1, 2)]
    runs = [("s", g, y, m, v) for y, m in months for g, v in (("A", 4.0), ("B", 0.0), ("C", 3.0))]
    reference = [(g, y, m, v) for y, m in months for g, v in (("A", 2.0), ("B", 0.0), ("C", 0.0))]
    ref = hydro.hydro_reference(spark.createDataFrame(reference, "generator_name string, Year int, Month int, Generation_GWh double"), 2025, 2030)
    january = ref.where("generator_name = 'A' AND Month = 1").first()
    assert january.reference_avg_flow_mw == pytest.approx(2000 / (31 * 24))
    ratios = hydro.hydro_ratio(spark.createDataFrame(runs, "scenario string, generator_name string, Year int, Month int, Generation_GWh double"), ref, years=[2025], stride=2)
    assert {(r.generator_name, r.CC_ratio) for r in ratios.collect()} == {("A", 2.0), ("B", 1.0), ("C", 1.0)}
    mapping = spark.createDataFrame(
        [("A", "1", "Z1", "Hydro_NonPumped", 0), ("B", "2", "Z2", "Hydro_NonPumped", 1), ("C", "3", "Z2", "Hydro_NonPumped", 0)],
        "generator_name string, project string, load_zone_name string, gen_tech string, not_generating int",
    )
    mapped = hydro.map_generators(ratios, mapping)
    series = spark.createDataFrame([(p, "2025_M01", 10.0, 5.0) for p in ("1", "3", "4", "5", "6")], "hydro_project string, timeseries string, hydro_avg_flow_mw double, hydro_min_flow_mw double")
    projects = spark.createDataFrame(
        [("1", "Z1", 15.0), ("3", "Z2", 8.0), ("4", "Z2", 100.0), ("5", "Z3", 100.0), ("6", "Z4", 100.0)],
        "GENERATION_PROJECT string, gen_load_zone string, gen_capacity_limit_mw double",
    ).withColumns({"gen_scheduled_outage_rate": F.lit(0.1), "gen_forced_outage_rate": F.lit(0.1)})
    nearest = spark.createDataFrame([("Z3", "Z1"), ("Z2", "Z1")], "zone_without_hydro string, nearest_zone_with_hydro string")
    scenarios = spark.createDataFrame([("s",)], "scenario string")
    applied = hydro.apply_ratio_with_fallback(hydro.with_series_months(series), mapped, hydro.zone_ratio(mapped), projects, nearest, scenarios)
    # own ratio; own ratio; listed zone uses its neighbour; neighbour; nothing to fall back on
    assert {r.hydro_project: r.CC_ratio_applied for r in applied.collect()} == {"1": 2.0, "3": 1.0, "4": 2.0, "5": 2.0, "6": None}
    clamped = {r.hydro_project: (r.hydro_avg_flow_mw_CC, r.hydro_min_flow_mw_CC) for r in hydro.derate_clamp(applied).collect()}
    assert clamped["1"] == pytest.approx((12.0, 6.0))  # only the new flow exceeds 80 % of capacity
    assert clamped["3"] == pytest.approx((8.0, 4.0))  # base and new flow exceed it
    assert clamped["4"] == (20.0, 10.0)
    assert clamped["6"] == (None, None)


def test_guarded_add_and_disaggregation(spark):
    monthly = spark.createDataFrame(
        [("s", 2030, 1, 31, "Z", 1, "f", "ag", "Pumping", -0.31), ("s", 2030, 1, 31, "Z", 1, "f", "ag", "None", 99.0)],
        "scenario string, Year int, Month int, days_in_month int, load_zone string, load_zone_id int, file_kind string, sector string, included_energy string, Delta_ElectricityUse_GWh double",
    )
    points = spark.createDataFrame([(1, "2030010100"), (2, "2030010101")], "timepoint_id int, timestamp string")
    wide = spark.createDataFrame([(0, 0.25), (1, 0.75)], "Hour int, AgUse double")
    sectors = spark.createDataFrame([("ag", "Pumping", "f", "AgUse")], "sector string, included_energy string, file_kind string, hour_weighting_category string")
    hourly = water_load.hourly_disaggregate(monthly, points, water_load.weights_long(wide, sectors))
    assert {r.timepoint_id: r.Sampled_Delta_ElecUse_GWh for r in hourly.collect()} == pytest.approx({1: -0.0025, 2: -0.0075})
    loads = spark.createDataFrame([("Z", 1, 10.0), ("Z", 2, 5.0), ("Y", 1, 7.0)], "LOAD_ZONE string, TIMEPOINT int, zone_demand_mw double")
    runs = spark.createDataFrame([("s",)], "scenario string")
    for fill, other in ((None, None), (0.0, 7.0)):
        got = {(r.LOAD_ZONE, r.TIMEPOINT): r.zone_demand_mw for r in water_load.adjusted_loads(water_load.guarded_add(loads, hourly, runs, fill)).collect()}
        assert got == {("Z", 1): 7.5, ("Z", 2): 5.0, ("Y", 1): other}


def test_object_names_shared_by_files(spark):
    rows = [(kind, "obj", y, 1, v) for kind, v in (("f2", 10.0), ("f1", 2.0)) for y in (2025, 2026)]
    exports = spark.createDataFrame(rows, "file_kind string, object_name string, Year int, Month int, GWh double")
    apart = water_load.averaged_use(exports, "use", [], years=[2025], stride=1)
    assert {r.file_kind: r.use for r in apart.collect()} == {"f1": 2.0, "f2": 10.0}
    merged = water_load.averaged_use(exports, "use", [], years=[2025], stride=1, file_order=["f2", "f1"])
    assert {r.file_kind: r.use for r in merged.collect()} == {"f1": 6.0, "f2": 6.0}


def test_disaggregation_by_cause(spark):
    rows = [(f, "S", 2050, c, v) for f, v in ((WATER_FAMILY, 1.0), (COOLING_FAMILY, 2.0), (COMBINED_FAMILY, 4.0)) for c in ("zone_demand_GWh", "Water", "Wind")]
    deltas = spark.createDataFrame(rows, "climate_impacts_included string, Scenario string, ts_period int, energy_category string, Delta_AnnualGen_GWh double")
    parts = compare.load_hydro_disaggregation(deltas)
    assert {r.energy_category_disagg: r.Delta_AnnualGen_GWh for r in parts.collect()} == {"Water Load": 1.0, "Cooling Load": 2.0, "Water": 4.0}
    assert {r.TotalImbalance_GWh for r in compare.imbalance_ranking(parts).collect()} == {-1.0}


def test_clone_keeps_what_is_not_overridden(spark):
    base = spark.createDataFrame([(202, "base", 7, "x")], "scenario_id int, name string, demand_scenario_id int, other string")
    over = spark.createDataFrame([(207, 202, "clone", None), (208, 202, "second", 160)], "scenario_id int, source_id int, name string, demand_scenario_id int")
    got = sorted(map(tuple, degree_days.clone_with_overrides(base, over).collect()))
    assert got == [(207, "clone", 7, "x"), (208, "second", 160, "x")]
