"""Calendar parts. Timestamps are TIMESTAMP_NTZ in UTC, so nothing depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col


def compact_timestamp(c: Column | str) -> Column:
    """``YYYYMMDDHH`` (number or text) to a UTC timestamp."""
    return F.to_timestamp_ntz(_col(c).cast("string"), F.lit("yyyyMMddHH"))


def with_compact_parts(df, column: str = "timestamp"):
    """Add Year, Month, Day, Hour_UTC and date_time_UTC read by position from ``YYYYMMDDHH``."""
    text = F.col(column).cast("string")
    return df.withColumns(
        {
            "Year": F.substring(text, 1, 4).cast("int"),
            "Month": F.substring(text, 5, 2).cast("int"),
            "Day": F.substring(text, 7, 2).cast("int"),
            "Hour_UTC": F.substring(text, 9, 2).cast("int"),
            "date_time_UTC": compact_timestamp(column),
        }
    )


def positional_int(c: Column | str, start: int, length: int) -> Column:
    return F.substring(_col(c), start, length).cast("int")


def with_date_parts(df, column: str = "Date"):
    d = F.col(column)
    return df.withColumns({"year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d)})


def days_in_month(year: Column | int, month: Column | str) -> Column:
    y = F.lit(year) if isinstance(year, int) else year
    return F.dayofmonth(F.last_day(F.make_date(y, _col(month), F.lit(1))))


def days_in_year(year: Column | str) -> Column:
    """Every fourth year is a leap year (exact for 1901-2099)."""
    return F.when(_col(year) % 4 == 0, F.lit(366)).otherwise(F.lit(365))


def shifted(ts: Column | str, hours: int) -> Column:
    """A fixed offset from UTC, without daylight saving."""
    return _col(ts) + F.make_dt_interval(F.lit(0), F.lit(hours))


def local_hour(ts: Column | str, zone: str = "America/Los_Angeles") -> Column:
    """Hour of day 1..24 in a named zone, with daylight saving."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts))) + 1


def hour_bin(hour: Column | str, width: int = 4) -> Column:
    """Label 1..24 hours by the last hour of their ``width``-hour bin."""
    return ((F.floor((_col(hour) - 1) / width) + 1) * width).cast("int")


def truncated_to_hour(ts: Column | str) -> Column:
    ts = _col(ts)
    midnight = ts.cast("date").cast("timestamp_ntz")
    return midnight + F.make_dt_interval(F.lit(0), F.hour(ts))


def season_of(month: Column | str) -> Column:
    m = _col(month)
    return (
        F.when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall").otherwise("Winter")
    )


def day_type_of(weight: Column | str) -> Column:
    """A timepoint that stands for one day of its month is a peak day, all others are median days."""
    return F.when(_col(weight) == 1, "peak_day").otherwise("median_day")
