"""Temperature to hourly climate-adjusted demand, for all scenarios and zones in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import shifted, with_date_parts
from ..functions.missing import clamp_at_zero, na_mean
from ..operators.matching import match
from ..operators.ordered import strided_mean
from ..operators.reshape import to_long

BASE_TEMPERATURE = (65 - 32) / 1.8  # 65 F in degrees C
DAILY_COLUMNS = [
    "Date",
    "year",
    "month",
    "day",
    "load_zone",
    "Scenario",
    "degree_day_type",
    "degree_day_C",
    "hist_avg_degree_day_C",
    "delta_degree_day_C",
    "avg_delta_degree_day_C",
]


def degree_days(
    df: DataFrame, tmin: str = "Tmin", tmax: str = "Tmax", base: float = BASE_TEMPERATURE, ndigits: int = 2
) -> DataFrame:
    """Heating and cooling degree days of the daily mean temperature."""
    mean = (F.col(tmax) + F.col(tmin)) / 2
    return df.withColumns(
        {
            "HDD": clamp_at_zero(F.round(F.lit(base) - mean, ndigits)),
            "CDD": clamp_at_zero(F.round(mean - F.lit(base), ndigits)),
        }
    )


def degree_days_long(df: DataFrame, ids: list[str]) -> DataFrame:
    return to_long(df.select(*ids, "HDD", "CDD"), ids, ["HDD", "CDD"], "degree_day_type", "degree_day_C")


def climatology(
    df: DataFrame,
    by: list[str] | None = None,
    start: str = "1980-01-01",
    end: str = "2011-01-01",
    date: str = "Date",
) -> DataFrame:
    """Mean HDD and CDD per calendar day and zone over [start, end), long by degree-day type."""
    by = by or ["month", "day", "load_zone"]
    reference = df.where((F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(end).cast("date")))
    means = with_date_parts(reference, date).groupBy(*by).agg(na_mean("HDD").alias("HDD"), na_mean("CDD").alias("CDD"))
    return to_long(means, by, ["HDD", "CDD"], "degree_day_type", "hist_avg_degree_day_C")


def climatology_delta(
    df: DataFrame, clim: DataFrame, until: str = "2071-01-01", start: str | None = None, date: str = "Date"
) -> DataFrame:
    """Difference of every projected day from the climatology of its calendar day, zone and type."""
    future = df.where(F.col(date) < F.lit(until).cast("date"))
    if start:
        future = future.where(F.col(date) >= F.lit(start).cast("date"))
    parts = with_date_parts(future, date)
    long = degree_days_long(parts, [date, "year", "month", "day", "load_zone", "Scenario"])
    joined = match(long, clim, ["month", "day", "load_zone", "degree_day_type"])
    return joined.withColumn("delta_degree_day_C", F.col("degree_day_C") - F.col("hist_avg_degree_day_C"))


def averaged_delta(
    delta: DataFrame,
    stride: int = 365,
    half_width: int = 5,
    include_last: bool = False,
    date: str = "Date",
    skip_nulls: bool = False,
) -> DataFrame:
    """Moving same-day-of-year mean of the deltas per scenario, zone and type."""
    averaged = strided_mean(
        delta,
        {"delta_degree_day_C": "avg_delta_degree_day_C"},
        ["Scenario", "load_zone", "degree_day_type"],
        [date],
        stride,
        half_width,
        include_last,
        skip_nulls,
    )
    return averaged.select(*[date if c == "Date" else c for c in DAILY_COLUMNS])


def areal_interpolate(
    source: DataFrame,
    fractions: DataFrame,
    source_key: str = "source_zone_id",
    target_keys: list[str] | None = None,
    value: str = "response_mw_per_delta_dd",
    fraction: str = "population_fraction",
    by: list[str] | None = None,
    name: str = "zone_response_mw_per_delta_dd",
) -> DataFrame:
    """Population-weighted sum of source-zone values per target zone."""
    target_keys = target_keys or ["load_zone_id", "load_zone_name"]
    by = by or ["timeslice_id", "type_degree_days"]
    weighted = source.join(fractions, source_key)
    return weighted.groupBy(*target_keys, *by).agg(F.sum(F.col(value) * F.col(fraction)).alias(name))


def expand_bands(bands: DataFrame, id_column: str = "timeslice_id") -> DataFrame:
    """One row per (band, month, hour) that the band covers.

    Hours run from start up to but not including end, months from start to end inclusive; both wrap
    around when start exceeds end. Equal start and end, or a null bound, cover nothing.
    """
    hs, he = F.col("hour_of_day_start"), F.col("hour_of_day_end")
    ms, me = F.col("month_start"), F.col("month_end")

    def in_hours(h: Column) -> Column:
        return ((hs < he) & (h >= hs) & (h < he)) | ((hs > he) & ((h >= hs) | (h < he)))

    def in_months(m: Column) -> Column:
        return ((ms < me) & m.between(ms, me)) | ((ms > me) & ((m >= ms) | (m <= me)))

    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), in_hours)
    months = F.filter(F.sequence(F.lit(1), F.lit(12)), in_months)
    by_month = bands.select(id_column, hours.alias("_hours"), F.explode(months).alias("band_month"))
    return by_month.select(id_column, "band_month", F.explode("_hours").alias("band_hour"))


def band_map(
    timepoints: DataFrame,
    bands: DataFrame,
    ts: str = "timestamp_utc",
    utc_offset_hours: int = -8,
    id_column: str = "timeslice_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Time band of every timepoint, by an equi-join on local standard month and hour."""
    local = shifted(ts, utc_offset_hours)
    keyed = timepoints.withColumns({"band_month": F.month(local), "band_hour": F.hour(local)})
    mapped = keyed.join(expand_bands(bands, id_column), ["band_month", "band_hour"])
    return mapped.select(id_column, *(keep or ["raw_timepoint_id"]))


def load_response(
    demand: DataFrame, slopes: DataFrame, mapped: DataFrame, demand_scenario_id: int | None = None
) -> DataFrame:
    """Degree-day response of every hour, zone and type."""
    if demand_scenario_id is not None:
        demand = demand.where(F.col("demand_scenario_id") == demand_scenario_id)
    hours = demand.select("raw_timepoint_id", "timestamp_utc", "load_zone_id", "load_zone_name").join(
        mapped, "raw_timepoint_id"
    )
    return hours.join(slopes, ["load_zone_id", "load_zone_name", "timeslice_id"]).select(
        "raw_timepoint_id",
        "timestamp_utc",
        "timeslice_id",
        "load_zone_id",
        "load_zone_name",
        "type_degree_days",
        "zone_response_mw_per_delta_dd",
    )


def banded_response(
    demand: DataFrame,
    slopes: DataFrame,
    bands: DataFrame,
    demand_scenario_id: int | None = None,
    utc_offset_hours: int = -8,
    id_column: str = "timeslice_id",
) -> DataFrame:
    """``load_response`` from the bands themselves, with each hour's demand as ``baseline_load_mw``.

    Demand rows meet the bands by month and hour and the slopes by zone and band, so demand is read once for the
    response and for the sum that ``with_baseline`` makes of it.
    """
    if demand_scenario_id is not None:
        demand = demand.where(F.col("demand_scenario_id") == demand_scenario_id)
    local = shifted("timestamp_utc", utc_offset_hours)
    keys = ["raw_timepoint_id", "timestamp_utc", "load_zone_id", "load_zone_name"]
    hours = demand.select(
        *keys, F.col("demand_mw").alias("baseline_load_mw"), F.month(local).alias("band_month"), F.hour(local).alias("band_hour")
    )
    banded = hours.join(expand_bands(bands, id_column), ["band_month", "band_hour"])
    return banded.join(slopes, ["load_zone_id", "load_zone_name", id_column]).select(
        *keys[:2], id_column, *keys[2:], "type_degree_days", "zone_response_mw_per_delta_dd", "baseline_load_mw"
    )


def avg_slope_by_year(response: DataFrame, year: int | None = 2050) -> DataFrame:
    """Mean hourly response per zone and type of one year (or of every year)."""
    dated = response.withColumn("year", F.year("timestamp_utc"))
    if year is not None:
        dated = dated.where(F.col("year") == year)
    return dated.groupBy("load_zone_id", "load_zone_name", "type_degree_days", "year").agg(
        F.avg("zone_response_mw_per_delta_dd").alias("avg_response_mw_per_delta_dd")
    )


def load_change(response: DataFrame, daily: DataFrame, scenarios: list[str] | None = None) -> DataFrame:
    """Hourly response times the averaged delta of its UTC date, per scenario."""
    if scenarios:
        daily = daily.where(F.col("Scenario").isin(scenarios))
    deltas = daily.select(
        F.col("load_zone").alias("load_zone_name"),
        F.col("Date").alias("timestamp_date"),
        F.col("degree_day_type").alias("type_degree_days"),
        "avg_delta_degree_day_C",
        F.col("Scenario").alias("climate_scenario"),
    )
    dated = response.withColumn("timestamp_date", F.col("timestamp_utc").cast("date"))
    joined = dated.join(deltas, ["load_zone_name", "timestamp_date", "type_degree_days"])
    return joined.withColumn(
        "added_demand_mw", F.col("zone_response_mw_per_delta_dd") * F.col("avg_delta_degree_day_C")
    )


def net_change(change: DataFrame) -> DataFrame:
    """Heating and cooling changes summed per hour, zone and scenario; the hour's demand is carried along if it is there."""
    carried = [c for c in ("baseline_load_mw",) if c in change.columns]
    return change.groupBy(
        "raw_timepoint_id", "timestamp_utc", "timestamp_date", "load_zone_id", "load_zone_name", "climate_scenario", *carried
    ).agg(F.sum("added_demand_mw").alias("net_added_demand_mw"))


def with_baseline(net: DataFrame) -> DataFrame:
    """Demand plus the net change of every scenario, from net changes that carry their hour's demand."""
    keys = ["load_zone_id", "load_zone_name", "raw_timepoint_id", "timestamp_utc"]
    final = F.col("baseline_load_mw") + F.col("net_added_demand_mw")
    return net.select(*keys, "baseline_load_mw", "net_added_demand_mw", "climate_scenario", final.alias("final_demand_mw"))


def adjust_demand(demand: DataFrame, net: DataFrame, demand_scenario_id: int | None = None) -> DataFrame:
    """Baseline demand plus the net change of every scenario."""
    if demand_scenario_id is not None:
        demand = demand.where(F.col("demand_scenario_id") == demand_scenario_id)
    keys = ["load_zone_id", "load_zone_name", "raw_timepoint_id", "timestamp_utc"]
    base = demand.select(*keys, F.col("demand_mw").alias("baseline_load_mw"))
    joined = base.join(net.select(*keys, "net_added_demand_mw", "climate_scenario"), keys)
    return joined.withColumn("final_demand_mw", F.col("baseline_load_mw") + F.col("net_added_demand_mw"))


def publish_series(adjusted: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjusted series under their new demand-scenario ids, and the rows that describe the ids.

    ``id_map`` has climate_scenario, demand_scenario_id, name and description.
    """
    ids = id_map.select("climate_scenario", "demand_scenario_id")
    series = adjusted.join(ids, "climate_scenario").select(
        "load_zone_id",
        "demand_scenario_id",
        "raw_timepoint_id",
        "load_zone_name",
        "timestamp_utc",
        F.col("final_demand_mw").alias("demand_mw"),
    )
    return series, id_map.select("demand_scenario_id", "name", "description")


def clone_with_overrides(
    base: DataFrame, overrides: DataFrame, key: str = "scenario_id", source_key: str = "source_id"
) -> DataFrame:
    """Copies of base rows under new keys, with the attributes named in ``overrides`` replaced.

    ``overrides`` has the new key, the key of the row it is copied from, and any base columns; a null
    there keeps the base value.
    """
    changed = [c for c in overrides.columns if c not in (key, source_key)]
    new = overrides.select(
        F.col(key).alias("_new_key"), F.col(source_key).alias(key), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )
    copied = base.join(new, key)
    values = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in changed}
    return copied.withColumns({**values, key: F.col("_new_key")}).select(*base.columns)


def adjusted_demand(
    temperatures: DataFrame,
    history: DataFrame,
    demand: DataFrame,
    slopes: DataFrame,
    fractions: DataFrame,
    bands: DataFrame,
    demand_scenario_id: int | None = None,
) -> DataFrame:
    """Daily temperatures to hourly adjusted demand by zone and scenario."""
    clim = climatology(degree_days(history))
    daily = averaged_delta(climatology_delta(degree_days(temperatures), clim))
    zone_slopes = areal_interpolate(slopes, fractions)
    response = banded_response(demand, zone_slopes, bands, demand_scenario_id)
    return with_baseline(net_change(load_change(response, daily)))
