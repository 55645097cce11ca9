"""Representative days: the peak and the median day of every month, with period weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import days_in_month, days_in_year
from ..functions.recode import PERIODS, Period
from ..operators.grouped import first_peak, nearest_to_median
from ..operators.matching import match
from ..operators.ordered import every_kth

HOURS_PER_TIMEPOINT = 1
PEAK_DAYS = 1


def system_load(demand: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Demand of all zones per timestamp (and per ``by``, usually the demand scenario)."""
    return demand.groupBy(*(by or []), "timestamp_utc", "raw_timepoint_id").agg(F.sum("demand_mw").alias("demand_mw"))


def _with_calendar(hourly: DataFrame) -> DataFrame:
    ts = F.col("timestamp_utc")
    return hourly.withColumns({"date": ts.cast("date"), "year": F.year(ts), "month": F.month(ts)})


def peak_days(hourly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """UTC date of the highest hour of every month, the earliest hour on ties."""
    groups = [*(by or []), "year", "month"]
    peak = first_peak(_with_calendar(hourly), "demand_mw", groups, "timestamp_utc")
    return peak.select(*groups, F.col("timestamp_utc").cast("date").alias("date"))


def median_days(hourly: DataFrame, by: list[str] | None = None) -> DataFrame:
    """UTC date whose mean load is nearest to the median of the month's daily means."""
    groups = [*(by or []), "year", "month"]
    daily = _with_calendar(hourly).groupBy(*groups, "date").agg(F.avg("demand_mw").alias("daily_mean"))
    return nearest_to_median(daily, "daily_mean", groups, "date")


def neighbouring_days(days: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return days.withColumns({"previous_day": F.date_add(d, -1), "next_day": F.date_add(d, 1)})


def _period_id(year: Column, periods: list[Period]) -> Column:
    expr = F
    for i, p in enumerate(periods):
        expr = expr.when(year == int(p.label), i + 1)
    return expr.otherwise(None)


def sampled_hours(
    hourly: DataFrame, periods: list[Period] | None = None, delta_t: int = 1, by: list[str] | None = None
) -> DataFrame:
    """All timepoints of the peak days and every ``delta_t``-th timepoint of the median days.

    Only the years that name a period are sampled. A day that is both is kept under both ids.
    """
    periods = PERIODS if periods is None else periods
    by = by or []
    dated = _with_calendar(hourly).where(F.col("year").isin([int(p.label) for p in periods]))
    days = peak_days(dated, by).withColumn("day_kind", F.lit("P")).unionByName(
        median_days(dated, by).withColumn("day_kind", F.lit("M"))
    )
    tagged = match(dated, days.select(*by, "date", "day_kind"), [*by, "date"], "inner")
    sampled = every_kth(tagged.where(F.col("day_kind") == "M"), [*by, "date"], ["timestamp_utc"], delta_t).unionByName(
        tagged.where(F.col("day_kind") == "P")
    ) if delta_t > 1 else tagged
    return sampled.select(
        *by,
        "timestamp_utc",
        "raw_timepoint_id",
        "demand_mw",
        "date",
        "year",
        "month",
        F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("_"), F.col("day_kind")).alias("id_column"),
        _period_id(F.col("year"), periods).alias("period_id"),
    )


def sample_weights(
    sampled: DataFrame, periods: list[Period] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Scaling of every sampled timepoint to its period.

    A peak day stands for one day of its month, a median day for all others. Windows here span the
    timepoints of one sampled day, or the sampled days of one period.
    """
    periods = PERIODS if periods is None else periods
    by = by or []
    day = Window.partitionBy(*by, "period_id", "id_column")
    length = F
    for i, p in enumerate(periods):
        length = length.when(F.col("period_id") == i + 1, p.length)
    peak = F.endswith(F.col("id_column"), F.lit("P"))
    month_days = days_in_month(F.col("year"), "month")
    dated = sampled.withColumns(
        {
            "days_in_month": month_days,
            "days_in_year": days_in_year("year"),
            "first_timepoint_utc": F.min("timestamp_utc").over(day),
            "last_timepoint_utc": F.max("timestamp_utc").over(day),
            "num_timepoints": F.count("raw_timepoint_id").over(day),
            "hours_per_tp": F.lit(HOURS_PER_TIMEPOINT),
            "no_days": F.when(peak, F.lit(PEAK_DAYS)).otherwise(month_days - PEAK_DAYS),
            "name": F.date_format("timestamp_utc", "yyyy-MM"),
            "_years": length.otherwise(None),
        }
    )
    scaled = dated.withColumn(
        "scaling_to_period",
        F.col("_years") * 24 * F.col("no_days") / (F.col("hours_per_tp") * F.col("num_timepoints")),
    )
    return scaled.withColumn(
        "weight", F.col("hours_per_tp") * F.col("num_timepoints") * F.col("scaling_to_period")
    ).drop("_years")


def sampled_timeseries(
    weighted: DataFrame, study_timeframe_id: int, time_sample_id: int, by: list[str] | None = None
) -> DataFrame:
    """One row per sampled day with ids from 0 in time order (within each sample)."""
    by = by or []
    days = weighted.dropDuplicates([*by, "period_id", "id_column"])
    # a sample has two days per month of each period
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("first_timepoint_utc", "id_column", "period_id")
    return days.select(
        *by,
        (F.row_number().over(order) - 1).alias("sampled_timeseries_id"),
        F.lit(study_timeframe_id).alias("study_timeframe_id"),
        F.lit(time_sample_id).alias("time_sample_id"),
        "period_id",
        F.col("id_column").alias("name"),
        "hours_per_tp",
        "num_timepoints",
        "first_timepoint_utc",
        "last_timepoint_utc",
        "scaling_to_period",
    )


def numbered_timepoints(
    weighted: DataFrame, study_timeframe_id: int, time_sample_id: int, by: list[str] | None = None
) -> DataFrame:
    """Sampled timepoints with the id of their series: its rank among the sample's days, as in ``sampled_timeseries``.

    A sample has two days per month of each period, so its timepoints are numbered together.
    """
    by = by or []
    order = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)]).orderBy("first_timepoint_utc", "id_column", "period_id")
    return weighted.select(
        *by,
        "raw_timepoint_id",
        F.lit(study_timeframe_id).alias("study_timeframe_id"),
        F.lit(time_sample_id).alias("time_sample_id"),
        (F.dense_rank().over(order) - 1).alias("sampled_timeseries_id"),
        "period_id",
        "timestamp_utc",
    )


def sampled_timepoints(weighted: DataFrame, timeseries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sampled timepoints with the id of their series."""
    by = by or []
    ids = timeseries.select(
        *by,
        "sampled_timeseries_id",
        "study_timeframe_id",
        "time_sample_id",
        "period_id",
        F.col("name").alias("id_column"),
    )
    points = weighted.select(*by, "period_id", "id_column", "raw_timepoint_id", "timestamp_utc")
    return match(points, ids, [*by, "period_id", "id_column"], "right").select(
        *by,
        "raw_timepoint_id",
        "study_timeframe_id",
        "time_sample_id",
        "sampled_timeseries_id",
        "period_id",
        "timestamp_utc",
    )
