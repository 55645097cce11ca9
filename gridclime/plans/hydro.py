"""Hydropower inputs adjusted by climate-to-reference ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month, positional_int
from ..functions.missing import is_undefined, na_mean, r_div
from ..functions.units import average_megawatt
from ..operators.matching import fallback_lookup, match, per_scenario
from ..operators.ordered import strided_mean
from ..sources.parameters import scenario_names

SAMPLED_YEARS = list(range(2025, 2056, 5))
TYPICAL_YEAR = 2021  # any year of 365 days


def hydro_reference(reference: DataFrame, start: int = 2016, end: int = 2052) -> DataFrame:
    """Mean monthly generation and average power of every generator in the reference run."""
    window = reference.where(F.col("Year").between(start, end))
    means = window.groupBy("generator_name", "Month").agg(na_mean("Generation_GWh").alias("Reference_Avg_Generation_GWh"))
    return means.withColumn(
        "reference_avg_flow_mw",
        average_megawatt("Reference_Avg_Generation_GWh", days_in_month(TYPICAL_YEAR, "Month")),
    )


def ratio_to_reference(
    df: DataFrame,
    reference: DataFrame,
    value: str,
    reference_value: str,
    by: list[str],
    name: str = "CC_ratio",
    undefined: float = 1.0,
) -> DataFrame:
    """Ratio to the reference; x/0 and 0/0 become ``undefined``, a missing side stays missing."""
    joined = match(df, reference, by)
    ratio = r_div(value, reference_value)
    return joined.withColumn(name, F.when(is_undefined(ratio), F.lit(undefined)).otherwise(ratio))


def hydro_ratio(
    runs: DataFrame,
    reference_means: DataFrame,
    start: int = 2025,
    end: int = 2055,
    years: list[int] | None = None,
    stride: int = 12,
    half_width: int = 5,
) -> DataFrame:
    """Ratio of the moving monthly mean of every run, generator and sampled year to the reference."""
    window = runs.where(F.col("Year").between(start, end))
    averaged = strided_mean(
        window,
        {"Generation_GWh": "CC_Avg_Generation_GWh"},
        ["scenario", "generator_name"],
        ["Year", "Month"],
        stride,
        half_width,
    )
    sampled = averaged.where(F.col("Year").isin(years or SAMPLED_YEARS)).select(
        "scenario", "generator_name", F.col("Year").alias("period"), "Month", "CC_Avg_Generation_GWh"
    )
    return ratio_to_reference(
        sampled,
        reference_means,
        "CC_Avg_Generation_GWh",
        "Reference_Avg_Generation_GWh",
        ["generator_name", "Month"],
    )


def map_generators(ratios: DataFrame, mapping: DataFrame, technology: str = "Hydro_NonPumped") -> DataFrame:
    """Ratios of the mapped, generating generators of one technology."""
    wanted = mapping.where((F.col("gen_tech") == technology) & (F.col("not_generating") == 0))
    return ratios.join(wanted, "generator_name")


def zone_ratio(mapped: DataFrame) -> DataFrame:
    """Mean ratio per period, month and zone; missing ratios are left out."""
    return mapped.groupBy("scenario", "period", "Month", "load_zone_name").agg(
        F.avg(F.when(~F.isnan("CC_ratio"), F.col("CC_ratio"))).alias("CC_ratio_lz_avg")
    )


def with_series_months(hydro: DataFrame, year_at: int = 1, month_at: int = 7) -> DataFrame:
    """Year and month read by position from the series name."""
    return hydro.withColumns(
        {"ts_period": positional_int("timeseries", year_at, 4), "month": positional_int("timeseries", month_at, 2)}
    )


def apply_ratio_with_fallback(
    hydro: DataFrame,
    mapped: DataFrame,
    zone_ratios: DataFrame,
    projects: DataFrame,
    nearest: DataFrame,
    scenarios: list[str] | DataFrame,
) -> DataFrame:
    """Scale average and minimum flows by the project's ratio, else by its lookup zone's mean ratio.

    ``hydro`` (hydro_project, ts_period, month, flows) has no scenario; ``scenarios`` lists the runs
    to produce, and every row is repeated for each of them.
    """
    runs = per_scenario(hydro, scenario_names(scenarios))
    own = mapped.select(
        "scenario",
        F.col("project").alias("hydro_project"),
        F.col("period").alias("ts_period"),
        F.col("Month").alias("month"),
        "CC_ratio",
    )
    with_own = match(runs, own, ["scenario", "hydro_project", "ts_period", "month"])
    with_project = match(with_own, projects, {"hydro_project": "GENERATION_PROJECT"})
    zones = zone_ratios.withColumnsRenamed({"period": "ts_period", "Month": "month"})
    applied = fallback_lookup(
        with_project,
        "CC_ratio",
        "gen_load_zone",
        zones,
        nearest,
        {"scenario": "scenario", "ts_period": "ts_period", "month": "month"},
        "load_zone_name",
        "CC_ratio_lz_avg",
        "zone_without_hydro",
        "nearest_zone_with_hydro",
        "CC_ratio_applied",
    )
    scaled = {f"{c}_CC": F.col(c) * F.col("CC_ratio_applied") for c in ("hydro_avg_flow_mw", "hydro_min_flow_mw")}
    capacity = F.col("gen_capacity_limit_mw")
    return applied.withColumns(scaled).withColumns(
        {
            "check_CC_cf": r_div(F.col("hydro_avg_flow_mw_CC"), capacity),
            "check_CC_cf_min": r_div(F.col("hydro_min_flow_mw_CC"), capacity),
        }
    )


def derate_clamp(
    df: DataFrame,
    base_avg: str = "hydro_avg_flow_mw",
    base_min: str = "hydro_min_flow_mw",
    new_avg: str = "hydro_avg_flow_mw_CC",
    new_min: str = "hydro_min_flow_mw_CC",
    capacity: str = "gen_capacity_limit_mw",
    outages: tuple[str, ...] = ("gen_scheduled_outage_rate", "gen_forced_outage_rate"),
) -> DataFrame:
    """Keep new flows within the derated capacity.

    Where both the base and the new capacity factor exceed the availability, the base flows are
    derated; where only the new one does, the flows become the derated capacity and half of it.
    """
    cap = F.col(capacity)
    available = F.lit(1.0) - sum((F.col(c) for c in outages[1:]), F.col(outages[0]))
    base_over = r_div(F.col(base_avg), cap) > available
    new_over = r_div(F.col(new_avg), cap) > available
    both = base_over & new_over
    avg = F.when(both, F.col(base_avg) * available).when(new_over, cap * available).otherwise(F.col(new_avg))
    low = F.when(both, F.col(base_min) * available).when(new_over, cap / 2 * available).otherwise(F.col(new_min))
    return df.withColumns({new_avg: avg, new_min: low})


def adjusted_series(clamped: DataFrame) -> DataFrame:
    """The adjusted series in the layout of the input table."""
    return clamped.select(
        "scenario",
        "hydro_project",
        "timeseries",
        F.col("hydro_min_flow_mw_CC").alias("hydro_min_flow_mw"),
        F.col("hydro_avg_flow_mw_CC").alias("hydro_avg_flow_mw"),
    )


def reserve_value(hydro: DataFrame, projects: DataFrame, timepoints: DataFrame) -> DataFrame:
    """Monthly mean capacity factor of every project at every sampled timepoint of the month.

    ``hydro`` has scenario, hydro_project, timeseries and the average flow; ``timepoints`` has
    timepoint_id, timestamp and timeseries. The (few) distinct timepoints are matched by month.
    """
    months = with_series_months(hydro).withColumnRenamed("ts_period", "year")
    capacities = projects.select("GENERATION_PROJECT", "gen_capacity_limit_mw")
    joined = match(months, capacities, {"hydro_project": "GENERATION_PROJECT"})
    factors = (
        joined.withColumn("_cf", r_div("hydro_avg_flow_mw", "gen_capacity_limit_mw"))
        .groupBy("scenario", "hydro_project", "year", "month")
        .agg(na_mean("_cf").alias("gen_capacity_value"))
    )
    points = timepoints.dropDuplicates(["timepoint_id", "timestamp", "timeseries"]).select(
        F.col("timepoint_id").alias("timepoint"),
        positional_int("timeseries", 6, 4).alias("year"),
        positional_int("timeseries", 11, 2).alias("month"),
    )
    return match(points, factors, ["month", "year"]).select(
        "scenario", F.col("hydro_project").alias("GENERATION_PROJECT"), "timepoint", "gen_capacity_value"
    )
