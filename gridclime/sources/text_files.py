"""Readers for text exports with preambles, data-dependent headers and metadata lines.

All files of all scenarios are read by one job, and a large file by many tasks: line numbers and headers come from
``lines``. Blank lines are passed over; a preamble counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import is_undefined
from ..operators.ordered import repeat_before_last
from .lines import cells, decoded_path, first_lines, is_blank, numbered_lines, path_part, trimmed

# Preamble lengths and labels of the input file formats.
TMAX_PREAMBLE = 41
TMIN_PREAMBLE = 34
HISTORICAL_PREAMBLE = 37
WIDE_EXPORT_PREAMBLE = 5
CATCHMENT_PREAMBLE = {"scenario": 15, "historical": 16}
CATCHMENT_METADATA_LINE = {"scenario": 10, "historical": 11}
LONGEST_PREAMBLE = max(CATCHMENT_PREAMBLE.values())
HEADER_WITHIN = 64  # a header stands at most this many lines behind its preamble
STATISTIC_COLUMNS = ["Max", "Min", "Sum", "Median", "SD", "Mean", "RMS"]
UNIT = r".Gigawatt.Hour."
SERIES_START = "2006-01-01"


def _mangled(names: Column) -> Column:
    """Column names as the downstream mapping tables spell them: every character outside letters,
    digits, '.' and '_' becomes '.', a name that starts with neither a letter nor a dot followed by a
    non-digit gets an X in front, and repeats are numbered."""
    plain = F.transform(names, lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}._]", "."))
    legal = F.transform(
        plain, lambda c: F.when(c.rlike(r"^(\p{L}|\.(?![0-9]))"), c).otherwise(F.concat(F.lit("X"), c))
    )
    def numbered(c: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(legal, F.lit(1), i), lambda x: x == c))
        return F.when(earlier > 0, F.concat_ws(".", c, earlier.cast("string"))).otherwise(c)

    return F.transform(legal, numbered)


def object_name(column: Column) -> Column:
    """Entity name from a mangled column name: unit removed, dots to spaces, trailing blanks trimmed."""
    without_unit = F.regexp_replace(column, f"^(.*?){UNIT}", "$1.")
    return F.rtrim(F.replace(without_unit, F.lit("."), F.lit(" ")))


def _heads(spark: SparkSession, glob: str | list[str], preamble: Column | int, beyond: int = HEADER_WITHIN) -> DataFrame:
    """(path, file, header, skipped): of each file, the first line after the preamble that is not blank, and the lines
    that are not blank before it. A Column goes by ``path``."""
    skip = F.lit(preamble) if isinstance(preamble, int) else preamble
    longest = preamble if isinstance(preamble, int) else LONGEST_PREAMBLE
    found = first_lines(spark, glob, longest + beyond).withColumn("path", decoded_path(F.col("file")))
    before, after = F.slice("head", F.lit(1), skip), F.slice("head", skip + 1, F.lit(beyond))
    full = F.filter(after, lambda l: ~is_blank(l))
    return found.select(
        "path", "file", F.try_element_at(full, F.lit(1)).alias("header"), F.size(F.filter(before, lambda l: ~is_blank(l))).alias("skipped")
    )


def _wide_block(spark: SparkSession, glob: str | list[str], preamble: Column | int, ids: list[str]) -> DataFrame:
    """Header plus data lines after the preamble, gathered to one row per (line, entity column).

    The files' headers, known from their first lines, meet the data lines by file, and a cell its name by place.
    """
    n = len(ids)
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size("_names") - n, F.lit(0)))
    heads = _heads(spark, glob, preamble).withColumn("_names", _mangled(trimmed(cells(F.col("header")))))
    lines = numbered_lines(spark, glob).join(heads.drop("header"), "file")
    row = lines.where(F.col("number") > F.col("skipped") + 1).withColumn("_cells", trimmed(cells(F.col("value"))))
    row = row.select("path", "_cells", F.explode(F.arrays_zip(rest("_names").alias("name"), rest("_cells").alias("cell"))).alias("_e"))
    return row.select(
        "path", *[F.try_element_at("_cells", F.lit(i + 1)).try_cast("int").alias(c) for i, c in enumerate(ids)],
        F.col("_e.name").alias("column_name"), F.col("_e.cell").try_cast("double").alias("value"),
    )


def read_series(
    spark: SparkSession,
    glob: str | list[str],
    preamble: Column | int,
    value: str,
    start: str | Column = SERIES_START,
    scenario_depth: int = 3,
) -> DataFrame:
    """Headerless one-value-per-line files with a preamble, one file per zone.

    Keeps the first column, drops the last row (a NaN), overwrites the then-last value by the one
    before it, and attaches dates by position from ``start``. The zone is the file name up to ``_t``;
    the scenario is the directory ``scenario_depth`` components from the end of the path.
    """
    heads = _heads(spark, glob, preamble).select("file", "path", "skipped")
    lines = numbered_lines(spark, glob).join(heads, "file").withColumns(
        {"position": F.col("number") - F.col("skipped"), "_length": F.col("n_lines") - F.col("skipped") - 1}
    )
    kept = lines.where((F.col("position") > 0) & (F.col("position") <= F.col("_length")))
    patched = repeat_before_last(kept, "position", "_length")
    number = F.trim(cells(F.col("value"))[0]).try_cast("double")
    first_day = F.to_date(F.lit(start)) if isinstance(start, str) else start
    return patched.select(
        path_part(F.col("path"), scenario_depth).alias("Scenario"),
        F.regexp_extract(path_part(F.col("path"), 1), "^(.*?)_t", 1).alias("load_zone"),
        F.date_add(first_day, (F.col("position") - 1).cast("int")).alias("Date"),
        F.when(~is_undefined(number), number).alias(value),
        F.col("position").cast("int").alias("position"),
    )


def temperature_preamble(historical: bool) -> dict[str, int]:
    if historical:
        return {"Tmax": HISTORICAL_PREAMBLE, "Tmin": HISTORICAL_PREAMBLE}
    return {"Tmax": TMAX_PREAMBLE, "Tmin": TMIN_PREAMBLE}


def read_temperatures(
    spark: SparkSession, root: str, historical: bool = False, start: str = SERIES_START
) -> DataFrame:
    """Daily Tmin and Tmax of every scenario and zone below ``root/<scenario>/tmintmax/``."""
    skip = temperature_preamble(historical)
    keys = ["Scenario", "load_zone", "Date", "position"]
    tmin = read_series(spark, f"{root}/*/tmintmax/*tmin*", skip["Tmin"], "Tmin", start)
    tmax = read_series(spark, f"{root}/*/tmintmax/*tmax*", skip["Tmax"], "Tmax", start)
    return tmin.join(tmax, keys).select(*keys[:3], "Tmin", "Tmax", "position")


def read_wide_export(
    spark: SparkSession,
    glob: str | list[str],
    value: str = "GWh",
    preamble: int = WIDE_EXPORT_PREAMBLE,
) -> DataFrame:
    """Monthly exports with one column per entity, to rows.

    File names are ``<scenario>_<kind>.csv``. Result: scenario, file_kind, Year, Month, object_name
    and the value; the statistic columns are dropped.
    """
    name = path_part(F.col("path"), 1)
    long = _wide_block(spark, glob, preamble, ["Year", "Month"])
    return long.select(
        F.regexp_extract(name, r"^(.*)_[^_]*$", 1).alias("scenario"),
        F.regexp_extract(name, r"_([^_]*)\.csv$", 1).alias("file_kind"),
        "Year",
        "Month",
        object_name(F.col("column_name")).alias("object_name"),
        F.col("value").alias(value),
    ).where(~F.col("object_name").isin(STATISTIC_COLUMNS))


def _catchment_keys() -> list[Column]:
    """Files are named ``<number> - <state>_<name>.csv`` in one directory per scenario."""
    name = path_part(F.col("path"), 1)
    label = F.regexp_extract(name, r"^.*? - (.*?)\.csv", 1)
    return [
        path_part(F.col("path"), 2).alias("Scenario"),
        F.regexp_extract(name, r"^(.*?) - ", 1).alias("Catchment_num"),
        label.alias("Catchment_name"),
        F.substring_index(label, "_", 1).alias("State"),
    ]


def _per_format(lengths: dict[str, int], historical_name: str) -> Column:
    historical = path_part(F.col("path"), 2) == historical_name
    return F.when(historical, lengths["historical"]).otherwise(lengths["scenario"])


def read_catchment_bands(spark: SparkSession, glob: str | list[str], historical_name: str = "Hist") -> DataFrame:
    """Elevation bands and their areas from the metadata line of every catchment file.

    Areas stand in parentheses (`` ha``), four-digit upper limits before `` m``; a band reaches from
    1000 m below its limit.
    """
    files = _heads(spark, glob, _per_format(CATCHMENT_METADATA_LINE, historical_name))
    text = F.replace(F.replace(F.col("header"), F.lit(","), F.lit(" ")), F.lit('"'), F.lit(""))
    text = F.regexp_replace(text, r"^[^:]*:", "")
    areas = F.transform(
        F.regexp_extract_all(text, F.lit(r"\((.+?)\)"), F.lit(1)),
        lambda a: F.replace(F.split(a, " ha")[0], F.lit(" "), F.lit("")).try_cast("double"),
    )
    limits = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{4})(?= m)"), F.lit(1)), lambda e: e.cast("int"))
    keys = ["Scenario", "Catchment_num", "Catchment_name", "State"]
    found = files.select(*_catchment_keys(), areas.alias("_areas"), limits.alias("_limits"))
    total = F.aggregate("_areas", F.lit(0.0), lambda a, b: a + b) * F.lit(0.01)
    band = found.select(
        *keys, total.alias("total_catchment_area_km2"), F.explode(F.arrays_zip("_areas", "_limits")).alias("_b")
    )
    upper = F.col("_b._limits")
    return band.select(
        *keys,
        F.concat_ws(".", (upper - 1000).cast("string"), F.lit("to"), upper.cast("string"), F.lit("m")).alias("Elevation"),
        F.col("_b._areas").alias("area_ha"),
        "total_catchment_area_km2",
    )


def read_catchment_data(spark: SparkSession, glob: str | list[str], historical_name: str = "Hist") -> DataFrame:
    """Monthly values per variable and elevation band of every catchment file."""
    long = _wide_block(spark, glob, _per_format(CATCHMENT_PREAMBLE, historical_name), ["Year", "Month"])
    parts = F.split("column_name", "..Elevation.", 2)
    return long.select(
        *_catchment_keys(), "Year", "Month", parts[0].alias("Var_type"), F.try_element_at(parts, F.lit(2)).alias("Elevation"), "value"
    )
