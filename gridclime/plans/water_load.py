"""Electricity for water: monthly changes mapped to zones and spread over sampled hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month, with_compact_parts
from ..functions.missing import na_sum, r_div
from ..functions.recode import rank_in
from ..functions.units import thousandfold, thousandth
from ..operators.matching import match, per_scenario
from ..operators.ordered import strided_mean
from ..sources.parameters import scenario_names
from ..operators.reshape import to_long
from .hydro import SAMPLED_YEARS

OBJECT_KEYS = ["file_kind", "object_name"]
# The four kinds of export files, in reading order.
FILE_KINDS = [
    "Demand Site Electricity Use Monthly",
    "Diversion Electricity Use Monthly",
    "Transmission Link Electricity Use Monthly",
    "Electricity Use Return Flows Monthly",
]


def averaged_use(
    exports: DataFrame,
    name: str,
    runs: list[str],
    start: int = 2025,
    end: int = 2055,
    years: list[int] | None = None,
    stride: int = 12,
    half_width: int = 5,
    file_order: list[str] | None = None,
) -> DataFrame:
    """Moving monthly mean of the sampled years per object.

    Objects are told apart by file and name. ``file_order`` instead makes one series of all objects
    of a name, file after file in the given order.
    """
    window = exports.where(F.col("Year").between(start, end))
    by, order = [*runs, *OBJECT_KEYS], ["Year", "Month"]
    if file_order:
        window = window.withColumn("_file", rank_in("file_kind", file_order))
        by, order = [*runs, "object_name"], ["_file", "Year", "Month"]
    averaged = strided_mean(window, {"GWh": name}, by, order, stride, half_width)
    sampled = averaged.where(F.col("Year").isin(years or SAMPLED_YEARS))
    return sampled.select(*runs, *OBJECT_KEYS, "Year", "Month", name)


def object_delta(
    reference: DataFrame, runs: DataFrame, mapping: DataFrame, scenarios: list[str] | DataFrame | None = None, **window
) -> DataFrame:
    """Change of every object between the reference and each run, with its sector, zone and use.

    ``scenarios`` lists the runs; where it is not given they are looked up in ``runs``.
    """
    base = averaged_use(reference, "Reference_ElectricityUse_GWh", [], **window)
    climate = averaged_use(runs, "CC_ElectricityUse_GWh", ["scenario"], **window)
    mapped = match(base, mapping, OBJECT_KEYS)
    per_run = per_scenario(mapped, scenario_names(runs if scenarios is None else scenarios))
    joined = match(per_run, climate, ["scenario", *OBJECT_KEYS, "Year", "Month"])
    return joined.withColumns(
        {
            "days_in_month": days_in_month(F.col("Year"), "Month"),
            "Delta_ElectricityUse_GWh": F.col("CC_ElectricityUse_GWh") - F.col("Reference_ElectricityUse_GWh"),
        }
    )


def water_energy_delta(objects: DataFrame) -> DataFrame:
    """Object changes summed by month, zone, file, sector and included use."""
    measures = ["CC_ElectricityUse_GWh", "Reference_ElectricityUse_GWh", "Delta_ElectricityUse_GWh"]
    return objects.groupBy(
        "scenario",
        "Year",
        "Month",
        "days_in_month",
        "load_zone",
        "load_zone_id",
        "file_kind",
        "sector",
        "included_energy",
    ).agg(*[na_sum(m).alias(m) for m in measures])


def weights_long(weights: DataFrame, sectors: DataFrame, hour: str = "Hour") -> DataFrame:
    """Hourly weights per (sector, included use, file) from a table with one column per category."""
    categories = [c for c in weights.columns if c != hour]
    long = to_long(weights, [hour], categories, "hour_weighting_category", "hourly_weight_per_day")
    return match(sectors, long, ["hour_weighting_category"])


def hourly_disaggregate(monthly: DataFrame, timepoints: DataFrame, weights: DataFrame) -> DataFrame:
    """Daily share of the monthly change times the weight of the hour, summed per timepoint and zone.

    ``timepoints`` has timepoint_id and the compact timestamp. Rows whose included use is "None" are
    left out. The changes are summed to one row per month, hour of day and zone before they meet the
    timepoints of that month and hour. A missing weight leaves the hour's sum undefined.
    """
    points = with_compact_parts(timepoints).select("timepoint_id", "Year", "Month", "Hour_UTC")
    used = monthly.where(F.col("included_energy") != "None")
    hours = weights.withColumnRenamed("Hour", "Hour_UTC")
    keyed = used.withColumn("Hour_UTC", F.explode(F.sequence(F.lit(0), F.lit(23))))
    weighted = match(keyed, hours, ["Hour_UTC", "sector", "included_energy", "file_kind"])
    share = F.col("Delta_ElectricityUse_GWh") / F.col("days_in_month") * F.col("hourly_weight_per_day")
    hourly = (
        weighted.withColumn("_share", share)
        .groupBy("scenario", "Year", "Month", "Hour_UTC", "load_zone")
        .agg(na_sum("_share").alias("Sampled_Delta_ElecUse_GWh"))
    )
    found = match(points, hourly, ["Year", "Month", "Hour_UTC"], "inner", nullable=False)
    return found.select("scenario", "timepoint_id", "load_zone", "Sampled_Delta_ElecUse_GWh")


def guarded_add(
    loads: DataFrame, delta: DataFrame, scenarios: list[str] | DataFrame, fill_missing: float | None = None, ndigits: int = 3
) -> DataFrame:
    """Load plus the hourly change; a negative result keeps the original load.

    A zone without water objects has no change: its load becomes null, or keeps its value with
    ``fill_missing=0``.
    """
    per_run = per_scenario(loads, scenario_names(scenarios))
    joined = match(per_run, delta, {"scenario": "scenario", "LOAD_ZONE": "load_zone", "TIMEPOINT": "timepoint_id"})
    change = F.col("Sampled_Delta_ElecUse_GWh")
    if fill_missing is not None:
        change = F.coalesce(change, F.lit(fill_missing))
    load = F.col("zone_demand_mw")
    total = load + thousandfold(change)
    kept = F.when(total < 0, load).otherwise(total)
    return joined.withColumns({"zone_demand_mw_with_CCdelta": kept}).withColumns(
        {
            "zone_demand_perc_change": r_div(F.col("zone_demand_mw_with_CCdelta") - load, load),
            "zone_demand_mw_rounded": F.round("zone_demand_mw_with_CCdelta", ndigits),
        }
    )


def adjusted_loads(guarded: DataFrame) -> DataFrame:
    """The adjusted loads in the layout of the input table."""
    return guarded.select(
        "scenario", "LOAD_ZONE", "TIMEPOINT", F.col("zone_demand_mw_rounded").alias("zone_demand_mw")
    )


def annualise(
    df: DataFrame,
    weights: DataFrame,
    on: list[str] | dict[str, str],
    measures: list[str],
    by: list[str],
    period_years: int = 5,
    use_duration: bool = True,
    to_gwh: bool = False,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Sampled power scaled to a year and summed by ``by``.

    ``use_duration=False`` leaves out the hours per timepoint (equal for hourly timepoints).
    """
    joined = match(df, weights, on)
    scale = F.col("ts_scale_to_period") / F.lit(period_years)
    if use_duration:
        scale = scale * F.col("ts_duration_of_tp")
    names = names or {m: m for m in measures}
    totals = []
    for m in measures:
        total = na_sum(F.col(m) * scale)
        totals.append((thousandth(total) if to_gwh else total).alias(names[m]))
    return joined.groupBy(*by).agg(*totals)


def annual_load_report(guarded: DataFrame, timepoints: DataFrame, timeseries: DataFrame) -> dict[str, DataFrame]:
    """Old and new loads and their difference by zone and month, zone and year, and year.

    The coarser tables are sums of the monthly one, so the hourly rows are read once per table only
    down to the monthly rows.
    """
    points = match(with_compact_parts(timepoints), timeseries, {"timeseries": "TIMESERIES"})
    measures = ["zone_demand_mw_with_CCdelta", "zone_demand_mw"]
    names = {m: f"scaled_{m}" for m in measures}
    monthly = annualise(
        guarded,
        points,
        {"TIMEPOINT": "timepoint_id"},
        measures,
        ["scenario", "LOAD_ZONE", "Month", "Year"],
        names=names,
    )

    def with_change(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "scaled_zone_CCdeltademand_mw",
            F.col("scaled_zone_demand_mw_with_CCdelta") - F.col("scaled_zone_demand_mw"),
        )

    def coarser(by: list[str]) -> DataFrame:
        return with_change(monthly.groupBy(*by).agg(*[na_sum(n).alias(n) for n in names.values()]))

    return {
        "zone_month": with_change(monthly),
        "zone_year": coarser(["scenario", "LOAD_ZONE", "Year"]),
        "system_year": coarser(["scenario", "Year"]),
    }
