"""Registered queries: degree days, load response, sampling, hydropower, electricity for water."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import quality
from ..operators import grouped, ordered
from ..plans import compare as co
from ..plans import degree_days as dd
from ..plans import hydro as hy
from ..plans import sampling as sa
from ..plans import water_load as wl
from . import inputs as i
from .inputs import shape, table, with_sql

SPAN = {"start": 1995, "end": 2001, "years": i.YEARS, "half_width": 2}
DATE = "strftime(Date, '%Y-%m-%d') AS Date"


def _climatology(spark: SparkSession, sf: str) -> DataFrame:
    return dd.climatology(dd.degree_days(i.history(spark, sf)), start="1995-01-01", end="1998-01-01")


def _delta(spark: SparkSession, sf: str) -> DataFrame:
    future = dd.degree_days(i.temperatures(spark, sf))
    return dd.climatology_delta(future, _climatology(spark, sf), start="1998-01-01")


def _event_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Degree days of the events minus their zone and type mean."""
    long = dd.degree_days_long(dd.degree_days(i.event_temperatures(spark, sf)), ["Scenario", "load_zone", "Date"])
    means = long.groupBy("load_zone", "degree_day_type").agg(F.avg("degree_day_C").alias("_mean"))
    return long.join(means, ["load_zone", "degree_day_type"]).withColumn(
        "avg_delta_degree_day_C", F.col("degree_day_C") - F.col("_mean")
    )


def _slopes(spark: SparkSession, sf: str) -> DataFrame:
    return dd.areal_interpolate(i.source_slopes(spark, sf), i.fractions(spark, sf))


def _band_map(spark: SparkSession, sf: str) -> DataFrame:
    timepoints = i.demand(spark, sf).select("raw_timepoint_id", "timestamp_utc").distinct()
    return dd.band_map(timepoints, i.bands(spark))


def _response(spark: SparkSession, sf: str) -> DataFrame:
    return dd.banded_response(i.demand(spark, sf), _slopes(spark, sf), i.bands(spark), 115)


def _change(spark: SparkSession, sf: str) -> DataFrame:
    return dd.load_change(_response(spark, sf), _event_daily(spark, sf))


def adjusted_demand(spark: SparkSession, sf: str) -> DataFrame:
    adjusted = dd.with_baseline(dd.net_change(_change(spark, sf)))
    return shape(
        adjusted,
        ["climate_scenario", "load_zone_id", "load_zone_name", "raw_timepoint_id", "timestamp_utc"],
        {"baseline_load_mw": 4, "net_added_demand_mw": 4, "final_demand_mw": 4},
    )


def q_degree_days(spark, sf):
    return shape(dd.degree_days(i.temperatures(spark, sf)), ["Scenario", "load_zone", "Date"], {"HDD": 2, "CDD": 2})


def q_climatology(spark, sf):
    return shape(
        _climatology(spark, sf), ["month", "day", "load_zone", "degree_day_type"], {"hist_avg_degree_day_C": 6}
    )


DAILY_KEYS = ["Scenario", "load_zone", "Date", "degree_day_type"]


def q_climatology_delta(spark, sf):
    values = {"degree_day_C": 2, "hist_avg_degree_day_C": 6, "delta_degree_day_C": 6}
    return shape(_delta(spark, sf), [*DAILY_KEYS[:3], "year", "month", "day", "degree_day_type"], values)


def q_averaged_delta(spark, sf):
    return shape(dd.averaged_delta(_delta(spark, sf)), DAILY_KEYS, {"avg_delta_degree_day_C": 6})


def q_averaged_delta_nulls(spark, sf):
    averaged = dd.averaged_delta(_delta(spark, sf), stride=7, half_width=2)
    return shape(averaged, DAILY_KEYS, {"avg_delta_degree_day_C": 6})


def _monthly_revenue(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"))
        .agg(F.sum("o_totalprice").alias("revenue"))
    )


def q_strided_mean_incl(spark, sf):
    averaged = ordered.strided_mean(_monthly_revenue(spark, sf), "revenue", ["o_orderpriority"], ["Year", "Month"], 12)
    return shape(averaged, ["o_orderpriority", "Year", "Month"], {"avg_revenue": 3})


def q_strided_mean_excl(spark, sf):
    averaged = ordered.strided_mean(
        _monthly_revenue(spark, sf), "revenue", ["o_orderpriority"], ["Year", "Month"], 12, include_last=False
    )
    return shape(averaged, ["o_orderpriority", "Year", "Month"], {"avg_revenue": 3})


def _strided_sql(edge: str) -> str:
    return f"""WITH s AS (SELECT o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m, sum(o_totalprice) AS r
          FROM orders GROUP BY 1, 2, 3),
        p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY y, m) AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM s)
        SELECT a.o_orderpriority, a.y AS Year, a.m AS Month, round(avg(b.r), 3) AS avg_revenue FROM p a LEFT JOIN p b
          ON a.o_orderpriority = b.o_orderpriority AND abs(a.p - b.p) <= 60 AND (a.p - b.p) % 12 = 0 AND {edge}
        GROUP BY 1, 2, 3"""


def q_areal_interpolate(spark, sf):
    keys = ["load_zone_id", "load_zone_name", "timeslice_id", "type_degree_days"]
    return shape(_slopes(spark, sf), keys, {"zone_response_mw_per_delta_dd": 6})


def q_band_map(spark, sf):
    return shape(_band_map(spark, sf), ["timeslice_id", "raw_timepoint_id"])


RESPONSE_KEYS = [
    "raw_timepoint_id",
    "timestamp_utc",
    "timeslice_id",
    "load_zone_id",
    "load_zone_name",
    "type_degree_days",
]


def q_load_response(spark, sf):
    return shape(_response(spark, sf), RESPONSE_KEYS, {"zone_response_mw_per_delta_dd": 6})


def q_avg_slope_by_year(spark, sf):
    keys = ["load_zone_id", "load_zone_name", "type_degree_days", "year"]
    return shape(dd.avg_slope_by_year(_response(spark, sf), 2024), keys, {"avg_response_mw_per_delta_dd": 6})


def q_slopes_with_centroids(spark, sf):
    """Mean response of the zones outside Canada and Mexico with their coordinates."""
    named = dd.avg_slope_by_year(_response(spark, sf), 2024).withColumn("load_zone_name", i.choose("load_zone_id", i.ZONES))
    placed = co.slopes_with_centroids(named, i.zone_centroids(spark, sf))
    return shape(placed, ["load_zone_id", "load_zone_name", "type_degree_days", "X", "Y"], {"avg_response_mw_per_delta_dd": 6})


def q_load_change(spark, sf):
    keys = [*RESPONSE_KEYS, "timestamp_date", "climate_scenario"]
    return shape(_change(spark, sf), keys, {"avg_delta_degree_day_C": 5, "added_demand_mw": 4})


def q_net_load_change(spark, sf):
    keys = ["raw_timepoint_id", "timestamp_utc", "timestamp_date", "load_zone_id", "load_zone_name", "climate_scenario"]
    return shape(dd.net_change(_change(spark, sf)), keys, {"net_added_demand_mw": 4})


def q_publish_scenarios(spark, sf):
    adjusted = dd.adjust_demand(i.demand(spark, sf), dd.net_change(_change(spark, sf)), 115)
    ids = spark.createDataFrame(
        [("S1", 160, "load S1", "id 115 + S1"), ("S2", 161, "load S2", "id 115 + S2"), ("S3", 162, "load S3", "id 115 + S3")],
        "climate_scenario string, demand_scenario_id int, name string, description string",
    )
    series, _ = dd.publish_series(adjusted, ids)
    master = i.demand(spark, sf).select(*series.columns).unionByName(series)
    keys = ["load_zone_id", "demand_scenario_id", "raw_timepoint_id", "load_zone_name", "timestamp_utc"]
    return shape(master, keys, {"demand_mw": 4})


def q_published_ids(spark, sf):
    """The rows that describe the new demand scenarios, one per order status, with the orders behind each."""
    known = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    ids = known.select(
        F.concat(F.lit("S"), "o_orderstatus").alias("climate_scenario"), (F.ascii("o_orderstatus") + 100).alias("demand_scenario_id"),
        F.concat(F.lit("load "), "o_orderstatus").alias("name"), F.concat(F.lit("id 115 + "), F.col("n").cast("string")).alias("description"),
    )
    adjusted = i.demand(spark, sf).select(
        "load_zone_id", "raw_timepoint_id", "load_zone_name", "timestamp_utc", F.lit("SF").alias("climate_scenario"), F.col("demand_mw").alias("final_demand_mw")
    )
    series, header = dd.publish_series(adjusted, ids)
    counted = series.groupBy("demand_scenario_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return shape(header.join(counted, "demand_scenario_id", "left"), ["demand_scenario_id", "name", "description", "n_rows"])


def q_negative_demand_days(spark, sf):
    """Dates with a negative hour, of customers' balances spread over the hours of events."""
    hours = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
    return shape(quality.negative_demand_days(hours, "c_acctbal", "ts"), ["date"])


def q_clone_scenario(spark, sf):
    base = table(spark, sf, "nation")
    overrides = table(spark, sf, "region").select(
        (F.col("r_regionkey") + 100).alias("n_nationkey"),
        F.col("r_regionkey").alias("source_id"),
        F.concat(F.lit("copy for "), F.col("r_name")).alias("n_name"),
        F.when(F.col("r_regionkey") > 2, F.lit(9)).alias("n_regionkey"),
    )
    clones = dd.clone_with_overrides(base, overrides, "n_nationkey", "source_id")
    return shape(base.unionByName(clones), ["n_nationkey", "n_name", "n_regionkey"])


# ---- sampling -----------------------------------------------------------------------------------


def _system(spark, sf):
    return sa.system_load(i.ship_hours(spark, sf), ["run"])


def _sampled(spark, sf):
    return sa.sampled_hours(_system(spark, sf), i.PERIODS, 2, ["run"])


def _weighted(spark, sf):
    return sa.sample_weights(_sampled(spark, sf), i.PERIODS, ["run"])


def q_system_load(spark, sf):
    return shape(_system(spark, sf), ["run", "timestamp_utc", "raw_timepoint_id"], {"demand_mw": 2})


def q_peak_days(spark, sf):
    return shape(sa.peak_days(_system(spark, sf), ["run"]), ["run", "year", "month", "date"])


def q_median_days(spark, sf):
    return shape(sa.median_days(_system(spark, sf), ["run"]), ["run", "year", "month", "date"])


def q_sampled_hours(spark, sf):
    return shape(_sampled(spark, sf), ["run", "timestamp_utc", "id_column", "period_id"], {"demand_mw": 2})


def q_sample_weights(spark, sf):
    keys = ["run", "timestamp_utc", "id_column", "period_id", "no_days", "num_timepoints", "first_timepoint_utc",
            "last_timepoint_utc"]
    return shape(_weighted(spark, sf), keys, {"scaling_to_period": 6, "weight": 6})


def _series(spark, sf):
    return sa.sampled_timeseries(_weighted(spark, sf), 39, 38, ["run"])


def q_sampled_timeseries(spark, sf):
    keys = ["run", "sampled_timeseries_id", "study_timeframe_id", "time_sample_id", "period_id", "name", "hours_per_tp",
            "num_timepoints", "first_timepoint_utc", "last_timepoint_utc"]
    return shape(_series(spark, sf), keys, {"scaling_to_period": 6})


def q_sampled_timepoints(spark, sf):
    points = sa.numbered_timepoints(_weighted(spark, sf), 39, 38, ["run"])
    keys = ["run", "raw_timepoint_id", "study_timeframe_id", "time_sample_id", "sampled_timeseries_id", "period_id",
            "timestamp_utc"]
    return shape(points, keys)


def q_weight_identity(spark, sf):
    checked = quality.weight_identity(_series(spark, sf), 3, ["run", "period_id"])
    return shape(checked, ["run", "period_id"], {"hours_in_year": 4})


def q_neighbouring_days(spark, sf):
    days = sa.neighbouring_days(sa.peak_days(_system(spark, sf), ["run"]))
    return shape(days, ["run", "date", "previous_day", "next_day"])


_TS = "strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS timestamp_utc"
_SERIES = """(SELECT *, row_number() OVER (PARTITION BY run ORDER BY first_ts, id) - 1 AS sid FROM (
    SELECT DISTINCT run, period_id, id, num_timepoints, first_ts, last_ts, scaling_to_period FROM weighted))"""


# ---- hydropower ---------------------------------------------------------------------------------


def _reference(spark, sf):
    return hy.hydro_reference(i.generation(spark, sf, True), 1995, 2000)


def _ratios(spark, sf):
    return hy.hydro_ratio(i.generation(spark, sf, False), _reference(spark, sf), **SPAN)


def _mapped(spark, sf):
    return hy.map_generators(_ratios(spark, sf), i.generator_mapping(spark, sf))


def _applied(spark, sf):
    mapped = _mapped(spark, sf)
    return hy.apply_ratio_with_fallback(
        hy.with_series_months(i.hydro_series(spark, sf)),
        mapped,
        hy.zone_ratio(mapped),
        i.projects(spark, sf),
        i.nearest_zones(spark, sf),
        i.RUNS,
    )


def q_hydro_reference(spark, sf):
    values = {"Reference_Avg_Generation_GWh": 6, "reference_avg_flow_mw": 6}
    return shape(_reference(spark, sf), ["generator_name", "Month"], values)


def q_hydro_ratio(spark, sf):
    values = {"CC_Avg_Generation_GWh": 6, "Reference_Avg_Generation_GWh": 6, "CC_ratio": 6}
    known = _ratios(spark, sf)
    return shape(known, ["scenario", "generator_name", "period", "Month"], values)


def q_map_generators(spark, sf):
    known = _mapped(spark, sf)
    return shape(known, ["scenario", "project", "load_zone_name", "period", "Month"], {"CC_ratio": 6})


def q_zone_ratio(spark, sf):
    zones = hy.zone_ratio(_mapped(spark, sf))
    return shape(zones, ["scenario", "period", "Month", "load_zone_name"], {"CC_ratio_lz_avg": 6})


def q_apply_ratio_with_fallback(spark, sf):
    applied = _applied(spark, sf)
    values = {"CC_ratio_applied": 6, "hydro_avg_flow_mw_CC": 5, "hydro_min_flow_mw_CC": 5, "check_CC_cf": 5}
    return shape(applied, ["scenario", "hydro_project", "timeseries", "lookup_zone"], values)


def q_derate_clamp(spark, sf):
    adjusted = hy.adjusted_series(hy.derate_clamp(_applied(spark, sf)))
    values = {"hydro_min_flow_mw": 8, "hydro_avg_flow_mw": 8}
    return shape(adjusted, ["scenario", "hydro_project", "timeseries"], values)


def q_capacity_factor_above_one(spark, sf):
    listed = quality.above(_applied(spark, sf), "check_CC_cf", 1.0)
    return shape(listed, ["scenario", "hydro_project", "timeseries"], {"check_CC_cf": 5})


def q_minimum_factor_above_one(spark, sf):
    listed = quality.above(_applied(spark, sf), "check_CC_cf_min", 1.0)
    return shape(listed, ["scenario", "hydro_project", "timeseries"], {"check_CC_cf_min": 5})


def q_reserve_value(spark, sf):
    series = hy.adjusted_series(hy.derate_clamp(_applied(spark, sf)))
    values = hy.reserve_value(series, i.projects(spark, sf), i.month_timepoints(spark, sf))
    return shape(values, ["scenario", "GENERATION_PROJECT", "timepoint"], {"gen_capacity_value": 5})


# ---- electricity for water ----------------------------------------------------------------------


def _objects(spark, sf):
    return wl.object_delta(
        i.exports(spark, sf, True), i.exports(spark, sf, False), i.object_mapping(spark, sf), i.RUNS, **SPAN
    )


def _monthly(spark, sf):
    return wl.water_energy_delta(_objects(spark, sf))


def _weights(spark, sf):
    return wl.weights_long(i.hourly_weights(spark, sf), i.sector_mapping(spark, sf))


def _hourly(spark, sf):
    points = i.water_timepoints(spark, sf)
    return wl.hourly_disaggregate(_monthly(spark, sf), points, _weights(spark, sf))


def _guarded(spark, sf, fill_missing=None):
    return wl.guarded_add(i.loads(spark, sf), _hourly(spark, sf), i.RUNS, fill_missing)


def q_water_energy_delta(spark, sf):
    keys = ["scenario", "Year", "Month", "days_in_month", "load_zone", "file_kind", "sector", "included_energy"]
    values = {"CC_ElectricityUse_GWh": 8, "Reference_ElectricityUse_GWh": 8, "Delta_ElectricityUse_GWh": 8}
    known = _monthly(spark, sf)
    return shape(known, keys, values)


def q_hourly_disaggregate(spark, sf):
    known = _hourly(spark, sf)
    return shape(known, ["scenario", "timepoint_id", "load_zone"], {"Sampled_Delta_ElecUse_GWh": 9})


def q_guarded_add(spark, sf):
    known = _guarded(spark, sf)
    return shape(
        known, ["scenario", "LOAD_ZONE", "TIMEPOINT"], {"zone_demand_mw_with_CCdelta": 6, "zone_demand_perc_change": 6}
    )


def _report(spark, sf, fill_missing=0.0):
    """Loads without a change count in full; without ``fill_missing`` they leave their totals undefined."""
    guarded = _guarded(spark, sf, fill_missing)
    return wl.annual_load_report(guarded, i.water_timepoints(spark, sf), i.water_timeseries(spark, sf))


REPORT_VALUES = {
    "scaled_zone_demand_mw_with_CCdelta": 3,
    "scaled_zone_demand_mw": 3,
    "scaled_zone_CCdeltademand_mw": 3,
}


def q_annual_load_zone_month(spark, sf):
    return shape(_report(spark, sf, None)["zone_month"], ["scenario", "LOAD_ZONE", "Month", "Year"], REPORT_VALUES)


def q_annual_load_zone_year(spark, sf):
    return shape(_report(spark, sf)["zone_year"], ["scenario", "LOAD_ZONE", "Year"], REPORT_VALUES)


def q_annual_load_system_year(spark, sf):
    return shape(_report(spark, sf)["system_year"], ["scenario", "Year"], REPORT_VALUES)


def q_unmapped_objects(spark, sf):
    expensive = i.object_mapping(spark, sf).where(F.col("included_energy") != "None")
    lines = i.exports(spark, sf, True).groupBy("file_kind", "object_name").agg(F.count(F.lit(1)).alias("n_months"))
    return shape(
        quality.unmapped(lines, expensive, ["file_kind", "object_name"]), ["file_kind", "object_name", "n_months"]
    )


def _report_sql(keys: str, groups: str, new: str = "sum(coalesce(new_mw, mw) * scale / 5)") -> str:
    return with_sql(
        "guarded points series",
        f"""SELECT {keys}, round({new}, 3) AS scaled_zone_demand_mw_with_CCdelta, round(sum(mw * scale / 5), 3) AS scaled_zone_demand_mw,
        round({new} - sum(mw * scale / 5), 3) AS scaled_zone_CCdeltademand_mw
        FROM guarded g JOIN points p ON g.TIMEPOINT = CAST(p.timestamp AS INTEGER) JOIN series s ON p.timeseries = s.timeseries
        GROUP BY {groups}""",
    )


_MONTH = "CAST(substr(p.timestamp, 5, 2) AS BIGINT) AS Month"
_YEAR = "CAST(substr(p.timestamp, 1, 4) AS BIGINT) AS Year"

QUERIES = {
    "minimum_factor_above_one": (
        q_minimum_factor_above_one,
        with_sql("applied", "SELECT scenario, hydro_project, timeseries, round(min_cc / cap, 5) AS check_CC_cf_min FROM applied WHERE min_cc / cap > 1"),
    ),
    "slopes_with_centroids": (
        q_slopes_with_centroids,
        with_sql("response", f""", slopes AS (SELECT load_zone_id, {i.sql_choose("load_zone_id", i.ZONES)} AS load_zone_name, type_degree_days, avg(slope) AS slope
            FROM response WHERE year(timestamp_utc) = 2024 GROUP BY 1, 2, 3)
            SELECT s.load_zone_id, s.load_zone_name, type_degree_days, X, Y, round(slope, 6) AS avg_response_mw_per_delta_dd FROM slopes s
            LEFT JOIN (SELECT n_regionkey AS k, count(*) AS X, count(DISTINCT s_nationkey) AS Y FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) c ON c.k = s.load_zone_id WHERE load_zone_name NOT IN ('CAN_ALB', 'CAN_BC', 'MEX_BAJA')"""),
    ),
    "published_ids": (
        q_published_ids,
        with_sql("demand", """SELECT ascii(o_orderstatus) + 100 AS demand_scenario_id, 'load ' || o_orderstatus AS name, 'id 115 + ' || count(*) AS description,
            CASE WHEN o_orderstatus = 'F' THEN (SELECT count(*) FROM demand) END AS n_rows FROM orders GROUP BY o_orderstatus"""),
    ),
    "negative_demand_days": (
        q_negative_demand_days,
        "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal < 0",
    ),
    "degree_days": (q_degree_days, with_sql("dd", f"SELECT Scenario, load_zone, {DATE}, HDD, CDD FROM dd")),
    "climatology": (
        q_climatology,
        with_sql("clim", "SELECT m AS month, d AS day, load_zone, degree_day_type, round(hist_avg_degree_day_C, 6) AS hist_avg_degree_day_C FROM clim"),
    ),
    "climatology_delta": (
        q_climatology_delta,
        with_sql(
            "delta_daily",
            f"""SELECT Scenario, load_zone, {DATE}, year(Date) AS year, month(Date) AS month, day(Date) AS day, degree_day_type, degree_day_C,
            round(hist_avg_degree_day_C, 6) AS hist_avg_degree_day_C, round(delta_degree_day_C, 6) + 0.0 AS delta_degree_day_C FROM delta_daily""",
        ),
    ),
    "averaged_delta": (
        q_averaged_delta,
        with_sql(
            "delta_daily",
            f"""SELECT a.Scenario, a.load_zone, strftime(a.Date, '%Y-%m-%d') AS Date, a.degree_day_type,
            round(CASE WHEN count(*) = count(b.v) THEN avg(b.v) END, 6) + 0.0 AS avg_delta_degree_day_C FROM series a LEFT JOIN series b ON a.Scenario = b.Scenario AND a.load_zone = b.load_zone
              AND a.degree_day_type = b.degree_day_type AND a.p % 365 = b.p % 365 AND abs(a.p - b.p) <= 1825 AND b.p < b.n GROUP BY 1, 2, 3, 4""",
        ).replace(
            " SELECT a.Scenario",
            """, series AS (SELECT Scenario, load_zone, Date, degree_day_type, delta_degree_day_C AS v,
              row_number() OVER (PARTITION BY Scenario, load_zone, degree_day_type ORDER BY Date) AS p,
              count(*) OVER (PARTITION BY Scenario, load_zone, degree_day_type) AS n FROM delta_daily)
            SELECT a.Scenario""",
        ),
    ),
    "averaged_delta_nulls": (
        q_averaged_delta_nulls,
        with_sql(
            "delta_daily",
            f"""SELECT a.Scenario, a.load_zone, strftime(a.Date, '%Y-%m-%d') AS Date, a.degree_day_type,
            round(CASE WHEN count(*) = count(b.v) THEN avg(b.v) END, 6) + 0.0 AS avg_delta_degree_day_C FROM series a LEFT JOIN series b ON a.Scenario = b.Scenario AND a.load_zone = b.load_zone
              AND a.degree_day_type = b.degree_day_type AND a.p % 7 = b.p % 7 AND abs(a.p - b.p) <= 14 AND b.p < b.n
            GROUP BY 1, 2, 3, 4""",
        ).replace(
            " SELECT a.Scenario",
            """, series AS (SELECT Scenario, load_zone, Date, degree_day_type, delta_degree_day_C AS v,
              row_number() OVER (PARTITION BY Scenario, load_zone, degree_day_type ORDER BY Date) AS p,
              count(*) OVER (PARTITION BY Scenario, load_zone, degree_day_type) AS n FROM delta_daily)
            SELECT a.Scenario""",
        ),
    ),
    "strided_mean_incl": (q_strided_mean_incl, _strided_sql("true")),
    "strided_mean_excl": (q_strided_mean_excl, _strided_sql("b.p < b.n")),
    "areal_interpolate": (
        q_areal_interpolate,
        with_sql("zone_slopes", "SELECT load_zone_id, load_zone_name, timeslice_id, type_degree_days, round(slope, 6) AS zone_response_mw_per_delta_dd FROM zone_slopes"),
    ),
    "band_map": (q_band_map, with_sql("band_map", "SELECT timeslice_id, raw_timepoint_id FROM band_map")),
    "load_response": (
        q_load_response,
        with_sql("response", f"SELECT raw_timepoint_id, {_TS}, timeslice_id, load_zone_id, load_zone_name, type_degree_days, round(slope, 6) AS zone_response_mw_per_delta_dd FROM response"),
    ),
    "avg_slope_by_year": (
        q_avg_slope_by_year,
        with_sql("response", """SELECT load_zone_id, load_zone_name, type_degree_days, year(timestamp_utc) AS year, round(avg(slope), 6) AS avg_response_mw_per_delta_dd
            FROM response WHERE year(timestamp_utc) = 2024 GROUP BY 1, 2, 3, 4"""),
    ),
    "load_change": (
        q_load_change,
        with_sql("change", f"""SELECT raw_timepoint_id, {_TS}, timeslice_id, load_zone_id, load_zone_name, type_degree_days,
            strftime(timestamp_date, '%Y-%m-%d') AS timestamp_date, climate_scenario, round(delta, 5) AS avg_delta_degree_day_C, round(added_demand_mw, 4) AS added_demand_mw FROM change"""),
    ),
    "net_load_change": (
        q_net_load_change,
        with_sql("net", f"""SELECT raw_timepoint_id, {_TS}, strftime(timestamp_date, '%Y-%m-%d') AS timestamp_date, load_zone_id, load_zone_name,
            climate_scenario, round(net, 4) AS net_added_demand_mw FROM net"""),
    ),
    "adjust_demand": (
        adjusted_demand,
        with_sql("adjusted", f"""SELECT climate_scenario, load_zone_id, load_zone_name, raw_timepoint_id, {_TS}, round(baseline_load_mw, 4) AS baseline_load_mw,
            round(net_added_demand_mw, 4) AS net_added_demand_mw, round(final_demand_mw, 4) AS final_demand_mw FROM adjusted"""),
    ),
    "publish_scenarios": (
        q_publish_scenarios,
        with_sql("adjusted", f"""SELECT load_zone_id, demand_scenario_id, raw_timepoint_id, load_zone_name, {_TS}, round(demand_mw, 4) AS demand_mw FROM (
            SELECT load_zone_id, demand_scenario_id, raw_timepoint_id, load_zone_name, timestamp_utc, demand_mw FROM demand
            UNION ALL SELECT load_zone_id, CASE climate_scenario WHEN 'S1' THEN 160 WHEN 'S2' THEN 161 ELSE 162 END, raw_timepoint_id, load_zone_name,
              timestamp_utc, final_demand_mw FROM adjusted)"""),
    ),
    "clone_scenario": (
        q_clone_scenario,
        """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
        SELECT r_regionkey + 100, 'copy for ' || r_name, CASE WHEN r_regionkey > 2 THEN 9 ELSE n_regionkey END
        FROM region JOIN nation ON n_nationkey = r_regionkey""",
    ),
    "system_load": (
        q_system_load,
        with_sql("ship_load", "SELECT run, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, CAST(epoch(ts) / 3600 AS BIGINT) AS raw_timepoint_id, mw AS demand_mw FROM ship_load"),
    ),
    "peak_days": (q_peak_days, with_sql("peaks", "SELECT run, y AS year, m AS month, strftime(date, '%Y-%m-%d') AS date FROM peaks")),
    "median_days": (q_median_days, with_sql("medians", "SELECT run, y AS year, m AS month, strftime(date, '%Y-%m-%d') AS date FROM medians")),
    "sampled_hours": (
        q_sampled_hours,
        with_sql("sampled", "SELECT run, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, id AS id_column, period_id, mw AS demand_mw FROM sampled"),
    ),
    "sample_weights": (
        q_sample_weights,
        with_sql("weighted", """SELECT run, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc, id AS id_column, period_id, no_days, num_timepoints,
            strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_timepoint_utc, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_timepoint_utc,
            round(scaling_to_period, 6) AS scaling_to_period, round(num_timepoints * scaling_to_period, 6) AS weight FROM weighted"""),
    ),
    "sampled_timeseries": (
        q_sampled_timeseries,
        with_sql("weighted", f"""SELECT run, sid AS sampled_timeseries_id, 39 AS study_timeframe_id, 38 AS time_sample_id, period_id, id AS name, 1 AS hours_per_tp,
            num_timepoints, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_timepoint_utc, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_timepoint_utc,
            round(scaling_to_period, 6) AS scaling_to_period FROM {_SERIES}"""),
    ),
    "sampled_timepoints": (
        q_sampled_timepoints,
        with_sql("weighted", f"""SELECT w.run, CAST(epoch(w.ts) / 3600 AS BIGINT) AS raw_timepoint_id, 39 AS study_timeframe_id, 38 AS time_sample_id,
            s.sid AS sampled_timeseries_id, w.period_id, strftime(w.ts, '%Y-%m-%d %H:%M:%S') AS timestamp_utc
            FROM weighted w JOIN {_SERIES} s ON w.run = s.run AND w.period_id = s.period_id AND w.id = s.id"""),
    ),
    "weight_identity": (
        q_weight_identity,
        with_sql("weighted", f"SELECT run, period_id, round(sum(scaling_to_period) * 24 / 3, 4) AS hours_in_year FROM {_SERIES} GROUP BY 1, 2"),
    ),
    "neighbouring_days": (
        q_neighbouring_days,
        with_sql("peaks", """SELECT run, strftime(date, '%Y-%m-%d') AS date, strftime(date - INTERVAL 1 DAY, '%Y-%m-%d') AS previous_day,
            strftime(date + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM peaks"""),
    ),
    "hydro_reference": (
        q_hydro_reference,
        with_sql("ref_mean", """SELECT generator_name, Month, round(ref_gwh, 6) AS Reference_Avg_Generation_GWh,
            round(ref_gwh * 1000 / (day(last_day(make_date(2021, CAST(Month AS INTEGER), 1))) * 24), 6) AS reference_avg_flow_mw FROM ref_mean"""),
    ),
    "hydro_ratio": (
        q_hydro_ratio,
        with_sql("ratios", """SELECT scenario, generator_name, period, Month, round(cc_gwh, 6) AS CC_Avg_Generation_GWh,
            round(ref_gwh, 6) AS Reference_Avg_Generation_GWh, round(ratio, 6) AS CC_ratio FROM ratios"""),
    ),
    "map_generators": (
        q_map_generators,
        with_sql("mapped", "SELECT scenario, project, load_zone_name, period, Month, round(ratio, 6) AS CC_ratio FROM mapped"),
    ),
    "zone_ratio": (
        q_zone_ratio,
        with_sql("zone_ratios", "SELECT scenario, period, Month, load_zone_name, round(ratio, 6) AS CC_ratio_lz_avg FROM zone_ratios"),
    ),
    "apply_ratio_with_fallback": (
        q_apply_ratio_with_fallback,
        with_sql("applied", """SELECT scenario, hydro_project, timeseries, lookup_zone, round(ratio, 6) AS CC_ratio_applied, round(avg_cc, 5) AS hydro_avg_flow_mw_CC,
            round(min_cc, 5) AS hydro_min_flow_mw_CC, round(avg_cc / cap, 5) AS check_CC_cf FROM applied"""),
    ),
    "derate_clamp": (
        q_derate_clamp,
        with_sql("clamped", "SELECT scenario, hydro_project, timeseries, round(min_cc, 8) AS hydro_min_flow_mw, round(avg_cc, 8) AS hydro_avg_flow_mw FROM clamped"),
    ),
    "capacity_factor_above_one": (
        q_capacity_factor_above_one,
        with_sql("applied", "SELECT scenario, hydro_project, timeseries, round(avg_cc / cap, 5) AS check_CC_cf FROM applied WHERE avg_cc / cap > 1"),
    ),
    "reserve_value": (
        q_reserve_value,
        with_sql("clamped", """SELECT scenario, hydro_project AS GENERATION_PROJECT, timepoint, round(cf, 5) AS gen_capacity_value FROM (
              SELECT scenario, hydro_project, y, m, avg(avg_cc / cap) AS cf FROM clamped GROUP BY 1, 2, 3, 4) c
            RIGHT JOIN (SELECT DISTINCT CAST(strftime(first, '%Y%m%d') AS BIGINT) AS timepoint, y, m FROM (
              SELECT o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m, min(o_orderdate) AS first FROM orders GROUP BY 1, 2, 3)) t ON t.y = c.y AND t.m = c.m"""),
    ),
    "water_energy_delta": (
        q_water_energy_delta,
        with_sql("use_delta", """SELECT scenario, Year, Month, dim AS days_in_month, load_zone, file_kind, sector, included_energy, round(cc, 8) AS CC_ElectricityUse_GWh,
            round(ref, 8) AS Reference_ElectricityUse_GWh, round(delta, 8) AS Delta_ElectricityUse_GWh FROM use_delta"""),
    ),
    "hourly_disaggregate": (
        q_hourly_disaggregate,
        with_sql("hourly_delta", "SELECT scenario, timepoint_id, load_zone, round(delta, 9) AS Sampled_Delta_ElecUse_GWh FROM hourly_delta"),
    ),
    "guarded_add": (
        q_guarded_add,
        with_sql("guarded", """SELECT scenario, LOAD_ZONE, TIMEPOINT, round(new_mw, 6) AS zone_demand_mw_with_CCdelta,
            round((new_mw - mw) / mw, 6) AS zone_demand_perc_change FROM guarded"""),
    ),
    "annual_load_zone_month": (q_annual_load_zone_month, _report_sql(f"scenario, LOAD_ZONE, {_MONTH}, {_YEAR}", "1, 2, 3, 4", "CASE WHEN count(*) = count(new_mw) THEN sum(new_mw * scale / 5) END")),
    "annual_load_zone_year": (q_annual_load_zone_year, _report_sql(f"scenario, LOAD_ZONE, {_YEAR}", "1, 2, 3")),
    "annual_load_system_year": (q_annual_load_system_year, _report_sql(f"scenario, {_YEAR}", "1, 2")),
    "unmapped_objects": (
        q_unmapped_objects,
        with_sql("ref_use objects", """SELECT file_kind, object_name, count(*) AS n_months FROM ref_use r WHERE NOT EXISTS (
            SELECT 1 FROM objects o WHERE o.included_energy <> 'None' AND o.file_kind = r.file_kind AND o.object_name = r.object_name) GROUP BY 1, 2"""),
    ),
}
