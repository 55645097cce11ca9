"""Registered queries over files: written from the given tables in the formats that the readers know, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import quality
from ..operators.matching import range_lookup
from ..session import scratch
from ..sources import parameters, sinks, tables, text_files
from ..sources.sinks import write_files
from . import inputs as i
from .inputs import shape, table, with_sql


def _with_preamble(lines: DataFrame, preamble: dict[int, Column]) -> DataFrame:
    """(file, number, line) with the lines of ``preamble`` (text by number below 0) in front of each file."""
    top = F.array(*[F.struct(F.lit(n).alias("number"), text.alias("line")) for n, text in preamble.items()])
    heads = lines.select("file").distinct().select("file", F.explode(top).alias("_t")).select("file", "_t.number", "_t.line")
    return lines.select("file", F.col("number").cast("int"), "line").unionByName(heads.select("file", F.col("number").cast("int"), "line"))


def _remarks(n: int) -> dict[int, Column]:
    """A preamble of n lines; every third one is blank."""
    return {k - 1000: F.lit(f"remark {k}, of the program" if k % 3 else "") for k in range(n)}


# ---- series, one value a line ----------------------------------------------------------------------


def q_series_files(spark, sf):
    """Daily temperatures as one file per scenario, zone and extreme, dated by position."""
    root = scratch(spark, "series")
    days = i.temperatures(spark, sf)
    for kind in ("Tmin", "Tmax"):
        file = F.concat_ws("", "Scenario", F.lit("/tmintmax/"), "load_zone", F.lit(f"_{kind.lower()}.csv"))
        lines = days.select(
            file.alias("file"), F.datediff("Date", F.lit("1900-01-01")).alias("number"), F.concat(F.col(kind).cast("string"), F.lit(",x")).alias("line")
        )
        write_files(_with_preamble(lines, _remarks(text_files.temperature_preamble(False)[kind])), root)
    found = text_files.read_temperatures(spark, root)
    return shape(found, ["Scenario", "load_zone", "Date", "position"], {"Tmin": 8, "Tmax": 8})


_SERIES_SQL = with_sql(
    "temps",
    """, placed AS (
      SELECT *, row_number() OVER (PARTITION BY Scenario, load_zone ORDER BY Date) AS position,
        count(*) OVER (PARTITION BY Scenario, load_zone) - 1 AS n
      FROM temps
    ), patched AS (
      SELECT *, lag(Tmin) OVER (PARTITION BY Scenario, load_zone ORDER BY position) AS min_before,
        lag(Tmax) OVER (PARTITION BY Scenario, load_zone ORDER BY position) AS max_before
      FROM placed WHERE position <= n
    )
    SELECT Scenario, load_zone, strftime(DATE '2006-01-01' + CAST(position - 1 AS INTEGER), '%Y-%m-%d') AS Date, position,
      round(CASE WHEN position = n AND n > 1 THEN min_before ELSE Tmin END, 8) AS Tmin,
      round(CASE WHEN position = n AND n > 1 THEN max_before ELSE Tmax END, 8) AS Tmax
    FROM patched""",
)


# ---- wide exports ------------------------------------------------------------------------------------

_KIND = "Hydropower Generation"


def q_wide_files(spark, sf):
    """Monthly quantities per line number, a column each; the files of the return flags have other columns in another order."""
    root = scratch(spark, "wide")
    lines = table(spark, sf, "lineitem")
    month = [F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")]
    wide = lines.groupBy("l_returnflag", *month).pivot("l_linenumber", list(range(1, 8))).agg(F.sum("l_quantity"))
    for flag, numbers in (("A", range(1, 8)), ("N", range(7, 0, -1)), ("R", [3, 4, 5, 6, 7, 1])):
        header = ["$Columns = Year", "Timestep", *[f'"Dam, {n}[Gigawatt Hour]"' for n in numbers]]
        header += [f"{s}[Gigawatt Hour]" for s in text_files.STATISTIC_COLUMNS]
        values = [F.coalesce(F.col(str(n)).cast("string"), F.lit("")) for n in numbers]
        values += [F.lit("9.5")] * len(text_files.STATISTIC_COLUMNS)
        rows = wide.where(F.col("l_returnflag") == flag).select(
            F.lit(f"{flag}_{_KIND}.csv").alias("file"), (F.col("y") * 12 + F.col("m")).alias("number"), F.concat_ws(",", "y", "m", *values).alias("line")
        )
        write_files(_with_preamble(rows, {**_remarks(text_files.WIDE_EXPORT_PREAMBLE), -1: F.lit(",".join(header))}), root)
    found = text_files.read_wide_export(spark, f"{root}/*.csv")
    return shape(found, ["scenario", "file_kind", "Year", "Month", "object_name"], {"GWh": 2})


_WIDE_SQL = f"""
WITH q AS (
  SELECT l_returnflag AS scenario, year(l_shipdate) AS Year, month(l_shipdate) AS Month, l_linenumber, sum(l_quantity) AS GWh
  FROM lineitem GROUP BY 1, 2, 3, 4
), months AS (SELECT DISTINCT scenario, Year, Month FROM q)
SELECT m.scenario, '{_KIND}' AS file_kind, m.Year, m.Month, 'Dam  ' || d.n AS object_name, round(q.GWh, 2) AS GWh
FROM months m JOIN (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS n) d ON m.scenario <> 'R' OR d.n <> 2
LEFT JOIN q ON q.scenario = m.scenario AND q.Year = m.Year AND q.Month = m.Month AND q.l_linenumber = d.n
"""

# ---- climate files with bands ------------------------------------------------------------------------

_BANDS = ("0 to 1000 m", "1000 to 2000 m")


def _catchment_files(spark, sf) -> str:
    """One file per order status (directory; F is the historical run) and priority; its areas stand in a metadata line."""
    root = scratch(spark, "catchments")
    orders = table(spark, sf, "orders").withColumn("Scenario", F.when(F.col("o_orderstatus") == "F", "Hist").otherwise(F.col("o_orderstatus")))
    file = F.concat_ws("", "Scenario", F.lit("/"), F.substring("o_orderpriority", 1, 1), F.lit(" - WA_"), F.substring("o_orderpriority", 3, 20), F.lit(".csv"))
    orders = orders.withColumn("file", file)
    header = ["$Columns = Year", "Month", *[f"{v}: Elevation {b}" for v in ("tavg C", "Prcp mm") for b in _BANDS]]
    monthly = orders.groupBy("file", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(
        F.max("o_totalprice").alias("a"), F.min("o_totalprice").alias("b"), F.count(F.lit(1)).alias("c"), F.countDistinct("o_custkey").alias("d")
    )
    lines = monthly.select("file", (F.col("y") * 12 + F.col("m")).cast("int").alias("number"), F.concat_ws(",", "y", "m", "a", "b", "c", "d").alias("line"))
    areas = orders.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("Area: 1000 m ("), F.col("n") + 0.5, F.lit(' ha), "2000 m" (1 '), F.lpad((F.col("n") % 1000).cast("string"), 3, "0"), F.lit(" ha)"))
    top = []
    for name, before in text_files.CATCHMENT_METADATA_LINE.items():
        between = text_files.CATCHMENT_PREAMBLE[name] - before - 1
        parts = [F.lit(f"remark {k}") for k in range(before)] + [text] + [F.lit(f"more {k}") for k in range(between)] + [F.lit(",".join(header))]
        chosen = areas.where((F.substring_index("file", "/", 1) == "Hist") == (name == "historical"))
        top.append(chosen.select("file", F.posexplode(F.array(*parts)).alias("number", "line")))
    write_files(lines.unionByName(top[0]).unionByName(top[1]), root)
    return f"{root}/*/*.csv"


_CATCHMENT = ["Scenario", "Catchment_num", "Catchment_name", "State"]
_CATCHMENT_SQL = """
WITH o AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'Hist' ELSE o_orderstatus END AS Scenario, substr(o_orderpriority, 1, 1) AS Catchment_num,
    'WA_' || substr(o_orderpriority, 3, 20) AS Catchment_name, 'WA' AS State, * FROM orders
)"""


def q_catchment_files(spark, sf):
    found = text_files.read_catchment_data(spark, _catchment_files(spark, sf))
    return shape(found, [*_CATCHMENT, "Year", "Month", "Var_type", "Elevation"], {"value": 4})


_CATCHMENT_DATA_SQL = f"""{_CATCHMENT_SQL}, monthly AS (
  SELECT Scenario, Catchment_num, Catchment_name, State, year(o_orderdate) AS Year, month(o_orderdate) AS Month,
    max(o_totalprice) AS a, min(o_totalprice) AS b, count(*) AS c, count(DISTINCT o_custkey) AS d
  FROM o GROUP BY ALL
), long AS (
  SELECT *, 'tavg.C' AS Var_type, '0.to.1000.m' AS Elevation, a AS v FROM monthly
  UNION ALL SELECT *, 'tavg.C', '1000.to.2000.m', b FROM monthly
  UNION ALL SELECT *, 'Prcp.mm', '0.to.1000.m', c FROM monthly
  UNION ALL SELECT *, 'Prcp.mm', '1000.to.2000.m', d FROM monthly
)
SELECT Scenario, Catchment_num, Catchment_name, State, Year, Month, Var_type, Elevation, round(CAST(v AS DOUBLE), 4) AS value FROM long
"""


def q_catchment_bands(spark, sf):
    found = text_files.read_catchment_bands(spark, _catchment_files(spark, sf))
    return shape(found, [*_CATCHMENT, "Elevation"], {"area_ha": 2, "total_catchment_area_km2": 4})


_CATCHMENT_BAND_SQL = f"""{_CATCHMENT_SQL}, areas AS (
  SELECT Scenario, Catchment_num, Catchment_name, State, count(*) + 0.5 AS a, 1000.0 + count(*) % 1000 AS b FROM o GROUP BY ALL
)
SELECT Scenario, Catchment_num, Catchment_name, State, e.Elevation, round(CAST(CASE e.k WHEN 0 THEN a ELSE b END AS DOUBLE), 2) AS area_ha,
  round(CAST((a + b) * 0.01 AS DOUBLE), 4) AS total_catchment_area_km2
FROM areas, (VALUES (0, '0.to.1000.m'), (1, '1000.to.2000.m')) AS e(k, Elevation)
"""

# ---- headered CSV files ------------------------------------------------------------------------------


def _csv_lines(df: DataFrame, file: Column, order: Column, columns: list[str]) -> DataFrame:
    """(file, number, line) of a headered file: the columns in the order given, text quoted where it needs to be."""
    def cell(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit("NA"))
        return F.when(text.rlike('[",]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    lines = df.select(file.alias("file"), order.cast("int").alias("number"), F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))
    return _with_preamble(lines, {-1: F.lit(",".join(columns))})


def q_degree_day_files(spark, sf):
    """Daily files per scenario and zone; the columns stand in another order in every other zone, and one file lacks one."""
    root = scratch(spark, "degree-days")
    days = i.temperatures(spark, sf).withColumns(
        {"HDD": F.greatest(F.lit(0.0), 10 - F.col("Tmin")), "CDD": F.greatest(F.lit(0.0), F.col("Tmax") - 10), "note": F.concat(F.lit('a "b", '), "load_zone")}
    )
    file = F.concat_ws("", "Scenario", F.lit("/"), "load_zone", F.lit("_CDD-HDD.csv"))
    first = F.substring("load_zone", 1, 1)
    orders = (("135", ["Date", "Tmin", "Tmax", "HDD", "CDD"]), ("2", ["note", "CDD", "Tmax", "HDD", "Tmin", "Date"]), ("4", ["CDD", "Date", "note", "Tmin", "Tmax"]))
    for zones, columns in orders:
        write_files(_csv_lines(days.where(F.contains(F.lit(zones), first)), file, F.datediff("Date", F.lit("1900-01-01")), columns), root)
    found = tables.read_degree_days(spark, f"{root}/*/*.csv")
    return shape(found, ["Scenario", "load_zone", "Date"], {c: 8 for c in ("Tmin", "Tmax", "HDD", "CDD")})


_DEGREE_DAY_SQL = with_sql(
    "temps",
    """SELECT Scenario, load_zone, strftime(Date, '%Y-%m-%d') AS Date, round(Tmin, 8) AS Tmin, round(Tmax, 8) AS Tmax,
      CASE WHEN load_zone[1] <> '4' THEN round(greatest(0.0, 10 - Tmin), 8) END AS HDD, round(greatest(0.0, Tmax - 10), 8) AS CDD
    FROM temps""",
)


# ---- result directories of runs ------------------------------------------------------------------------

#: Run directory of each return flag, and the columns of its file.
_RUNS = {
    "A": ("base", ["PERIOD", "GENERATION_PROJECT", "gen_load_zone", "gen_tech", "gen_energy_source", "GenCapacity"]),
    "N": ("base_CCSM_CDD_HDD", ["extra", "GenCapacity", "gen_energy_source", "gen_tech", "gen_load_zone", "GENERATION_PROJECT", "PERIOD"]),
    "R": ("base_CanESM_Hydro_Load", ["GENERATION_PROJECT", "PERIOD", "GenCapacity", "gen_load_zone", "gen_energy_source", "gen_tech"]),
}


def q_result_files(spark, sf):
    """Capacities of three runs below one folder, each file with its own header, read for the runs of a dimension."""
    root = scratch(spark, "runs")
    found = table(spark, sf, "lineitem").groupBy(
        "l_returnflag", F.year("l_shipdate").alias("PERIOD"), F.col("l_suppkey").alias("GENERATION_PROJECT"), F.col("l_linestatus").alias("gen_load_zone")
    ).agg(F.sum("l_quantity").alias("q"), F.min("l_linenumber").alias("n"))
    found = found.withColumns(
        {
            "gen_tech": F.concat(F.lit("tech, "), "n"), "gen_energy_source": F.concat(F.lit('"s" '), "n"), "extra": F.lit("-"),
            "GenCapacity": F.when(F.col("q") % 3 > 0, F.col("q")),
        }
    )
    number = F.col("PERIOD") * 100_000 + F.col("GENERATION_PROJECT")
    for flag, (run, columns) in _RUNS.items():
        write_files(_csv_lines(found.where(F.col("l_returnflag") == flag), F.lit(f"{run}/outputs/gen_cap.csv"), number, columns), root)
    dimension = parameters.scenario_dimension(spark, "base", [parameters.COOLING_FAMILY, parameters.WATER_FAMILY])
    read = tables.read_results(spark, root, "outputs/gen_cap.csv", dimension, complete=True)
    keys = ["run_id", "Scenario", "climate_impacts_included", "PERIOD", "GENERATION_PROJECT", "gen_load_zone", "gen_tech", "gen_energy_source"]
    return shape(read, keys, {"GenCapacity": 2})


_RESULT_SQL = f"""
WITH runs AS (
  SELECT * FROM (VALUES ('A', 'base', '{parameters.BASELINE}', '{parameters.COOLING_FAMILY}'), ('A', 'base', '{parameters.BASELINE}', '{parameters.WATER_FAMILY}'),
    ('N', 'base_CCSM_CDD_HDD', 'CCSM', '{parameters.COOLING_FAMILY}'), ('R', 'base_CanESM_Hydro_Load', 'CanESM', '{parameters.WATER_FAMILY}')
  ) AS t(flag, run_id, Scenario, climate_impacts_included)
), q AS (
  SELECT l_returnflag, year(l_shipdate) AS PERIOD, CAST(l_suppkey AS VARCHAR) AS GENERATION_PROJECT, l_linestatus AS gen_load_zone,
    sum(l_quantity) AS q, min(l_linenumber) AS n
  FROM lineitem GROUP BY 1, 2, 3, 4
)
SELECT run_id, Scenario, climate_impacts_included, PERIOD, GENERATION_PROJECT, gen_load_zone, 'tech, ' || n AS gen_tech,
  '"s" ' || n AS gen_energy_source, round(q, 2) AS GenCapacity
FROM q JOIN runs ON flag = l_returnflag WHERE q % 3 > 0
"""


def q_scenario_dimension(spark, sf):
    """Names and labels of the runs of customer segments (climates), with the customers of each."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("Scenario")).agg(F.count(F.lit(1)).alias("n"))
    segments = [r[0] for r in counts.select("Scenario").orderBy("Scenario").collect()]
    dimension = parameters.scenario_dimension(spark, "base", climates=segments)
    return shape(dimension.join(counts, "Scenario", "left"), [*dimension.columns, "n"])


_DIMENSION_SQL = f"""
WITH families AS (
  SELECT * FROM (VALUES {", ".join(f"('{f}', '{s}', '{l}')" for f, (s, l) in parameters.FAMILY_SUFFIX.items())}) AS t(family, suffix, label)
), counts AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)
SELECT 'base_' || c_mktsegment || '_' || suffix AS run_id, c_mktsegment AS Scenario, c_mktsegment || ' ' || label AS scenario_label,
  family AS climate_impacts_included, n FROM counts, families
UNION ALL SELECT 'base', '{parameters.BASELINE}', '{parameters.BASELINE}', family, NULL FROM families
"""

# ---- tables as text --------------------------------------------------------------------------------------


def q_demand_files(spark, sf):
    """Hourly demand exported with two more columns than are read, and read back typed."""
    path = scratch(spark, "demand")
    demand = i.demand(spark, sf).withColumns({"note": F.lit("x"), "more": F.lit(1)})
    sinks.write_csv(demand.select(*tables.DEMAND_COLUMNS, "note", "more"), path)
    read = tables.load_data(tables.read_demand(spark, path), 115)
    return shape(read, [*tables.DEMAND_COLUMNS, "date"][:5] + ["date"], {"demand_mw": 4})


_DEMAND_SQL = with_sql(
    "demand",
    """SELECT load_zone_id, demand_scenario_id, raw_timepoint_id, load_zone_name, strftime(timestamp_utc, '%Y-%m-%d %H:%M:%S') AS timestamp_utc,
      strftime(timestamp_utc, '%Y-%m-%d') AS date, round(demand_mw, 4) AS demand_mw FROM demand""",
)


def q_bulk_load(spark, sf):
    """A bulk file whose text is quoted and has escaped quotes and separators in it."""
    root = scratch(spark, "bulk")
    text = F.concat(F.lit('"'), "c_mktsegment", F.lit(", '\""), "c_name", F.lit("'\"\""))
    rows = table(spark, sf, "customer").select(
        F.concat(F.lit("customers-"), F.col("c_custkey") % 3, F.lit(".csv")).alias("file"), F.col("c_custkey").alias("number"),
        F.concat_ws(",", "c_custkey", text, "c_acctbal").alias("line"),
    )
    write_files(_with_preamble(rows, {-1: F.lit("key,name,balance")}), root)
    schema = T.StructType().add("key", "long").add("name", "string").add("balance", "double")
    return shape(tables.read_bulk_csv(spark, root, schema), ["key", "name"], {"balance": 2})


def q_dimension_files(spark, sf):
    """Nations per region in one file each; columns in another order, and one file without the region's name."""
    root = scratch(spark, "dimension")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.withColumn("label", F.concat("r_name", F.lit(', "'), "n_name"))
    for even, columns in ((0, ["n_nationkey", "n_name", "r_name", "label"]), (1, ["label", "n_name", "n_nationkey"])):
        file = F.concat(F.lit("region-"), "n_regionkey", F.lit(".csv"))
        write_files(_csv_lines(nations.where(F.col("n_regionkey") % 2 == even), file, F.col("n_nationkey"), columns), root)
    columns = {"label": "string", "n_nationkey": "int", "r_name": "string", "n_name": "string"}
    return shape(tables.read_dimension(spark, f"{root}/*.csv", columns), list(columns))


def q_named_outputs(spark, sf):
    """Two result tables written below one folder by name, and read back."""
    root = scratch(spark, "outputs")
    orders = table(spark, sf, "orders")
    counts = {c: orders.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")) for c in ("o_orderstatus", "o_orderpriority")}
    sinks.write_outputs(counts, root)
    sinks.write_outputs({f"{name}_csv": df for name, df in counts.items()}, root, "csv")
    parts = [spark.read.parquet(f"{root}/{name}").withColumn("output", F.lit(name)) for name in counts]
    parts += [spark.read.csv(f"{root}/{name}_csv", header=True, schema="key string, n long").withColumn("output", F.lit(f"{name}_csv")) for name in counts]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return shape(union, ["output", "key", "n"])


def q_rebuild_versions(spark, sf):
    """A derived table rebuilt with other rows: the version before and the one after."""
    path = scratch(spark, "rebuild")
    yearly = table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    sinks.rebuild(yearly, path, ["o_orderpriority"])
    first = sinks.versions(spark, path)[-1]
    now = sinks.rebuild(yearly.where("y % 2 = 0").withColumn("n", -F.col("n")), path, ["o_orderpriority"])
    before = sinks.read_version(spark, path, first)
    both = before.withColumn("version", F.lit("former")).unionByName(now.withColumn("version", F.lit("current")))
    return shape(both, ["version", "o_orderpriority", "y", "n"])


def q_new_path(spark, sf):
    """Adjusted rows written to a path of their own; the rows they came from are read again beside them."""
    path = scratch(spark, "adjusted")
    stocks = table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("size"))
    sinks.write_new(stocks, f"{path}/original")
    sinks.write_new(spark.read.parquet(f"{path}/original").withColumn("size", F.col("size") * 2), f"{path}/adjusted")
    parts = [spark.read.parquet(f"{path}/{name}").withColumn("version", F.lit(name)) for name in ("original", "adjusted")]
    return shape(parts[0].unionByName(parts[1]), ["version", "p_brand", "size"])


def q_checked_write(spark, sf):
    """Metrics of a table, counted by the job that writes it: rows, repeated keys, unmapped rows, months without 12 rows."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m")).agg(
        F.sum("l_quantity").alias("q")
    )
    mapped = lines.join(table(spark, sf, "supplier").where("s_nationkey < 20"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    marked = quality.mark_group_size(quality.mark_repeats(mapped, ["l_suppkey", "y", "m"]), ["l_suppkey", "y"])
    metrics = {
        "n_rows": F.count(F.lit(1)),
        "n_repeated": quality.n_where("_repeat"),
        "n_unmapped": quality.n_where("s_suppkey is null"),
        "n_in_short_years": quality.n_where("_group_size <> 12"),
        "n_small": quality.n_where("q < 30"),
        "quantity": F.sum("q"),
    }
    kept, found = sinks.rebuild_checked(
        marked.select("l_suppkey", "y", "m", "q", "s_suppkey", "_repeat", "_group_size"), scratch(spark, "checked"), ["y"], metrics,
        expected={"n_repeated": 0}, without=["_repeat", "_group_size"],
    )
    read = kept.agg(F.count(F.lit(1)).alias("n_read"))
    return shape(read.withColumns({name: F.lit(value) for name, value in found.items()}), ["n_read", *list(metrics)[:-1]], {"quantity": 2})


def q_period_lookup(spark, sf):
    """Orders per investment period of a sampling configuration; two periods overlap and one is open."""
    config = {
        "study_timeframe": {"id": 7}, "sampling": {"id": 3},
        "periods": {"1996": {"start_year": 1995, "end_year": 1997}, "1999": {"start_year": 1998, "end_year": 2000}, "2000": {"start_year": 2000, "end_year": 2000}},
    }
    periods = parameters.period_frame(spark, parameters.sampling_from_config(config))
    periods = periods.withColumn("end_year", F.when(F.col("label") != "2000", F.col("end_year")))
    days = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    found = range_lookup(days, "y", periods.drop("study_timeframe_id", "length_yrs"), "start_year", "end_year")
    return shape(found, ["y", "o_orderstatus", "period_id", "label", "start_year", "end_year", "n"])


_YEARLY = "SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2"
QUERIES = {
    "series_files": (q_series_files, _SERIES_SQL),
    "wide_files": (q_wide_files, _WIDE_SQL),
    "catchment_files": (q_catchment_files, _CATCHMENT_DATA_SQL),
    "catchment_bands": (q_catchment_bands, _CATCHMENT_BAND_SQL),
    "degree_day_files": (q_degree_day_files, _DEGREE_DAY_SQL),
    "result_files": (q_result_files, _RESULT_SQL),
    "scenario_dimension": (q_scenario_dimension, _DIMENSION_SQL),
    "demand_files": (q_demand_files, _DEMAND_SQL),
    "bulk_load": (
        q_bulk_load,
        "SELECT c_custkey AS key, c_mktsegment || ', \"' || c_name || '\"' AS name, round(c_acctbal, 2) AS balance FROM customer",
    ),
    "dimension_files": (
        q_dimension_files,
        """SELECT n_nationkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN r_name END AS r_name, r_name || ', "' || n_name AS label
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "named_outputs": (
        q_named_outputs,
        " UNION ALL ".join(
            f"SELECT '{c}{s}' AS output, {c} AS key, count(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderstatus", "o_orderpriority") for s in ("", "_csv")
        ),
    ),
    "rebuild_versions": (
        q_rebuild_versions,
        f"""WITH q AS ({_YEARLY}) SELECT 'former' AS version, o_orderpriority, y, n FROM q
        UNION ALL SELECT 'current', o_orderpriority, y, -n FROM q WHERE y % 2 = 0""",
    ),
    "checked_write": (
        q_checked_write,
        """WITH q AS (SELECT l_suppkey, year(l_shipdate) AS y, month(l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
        g AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey, y) AS size FROM q LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey < 20)
        SELECT count(*) AS n_read, count(*) AS n_rows, 0 AS n_repeated, count(*) FILTER (s_suppkey IS NULL) AS n_unmapped,
          count(*) FILTER (size <> 12) AS n_in_short_years, count(*) FILTER (q < 30) AS n_small, round(sum(q), 2) AS quantity FROM g""",
    ),
    "period_lookup": (
        q_period_lookup,
        """WITH p AS (SELECT * FROM (VALUES (1, '1996', 1995, 1997), (2, '1999', 1998, 2000), (3, '2000', 2000, NULL)) AS t(period_id, label, start_year, end_year)),
        d AS (SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
        SELECT y, o_orderstatus, period_id, label, start_year, end_year, n FROM d LEFT JOIN p ON y >= start_year AND (end_year IS NULL OR y <= end_year)""",
    ),
    "new_path": (
        q_new_path,
        """WITH q AS (SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1)
        SELECT 'original' AS version, p_brand, size FROM q UNION ALL SELECT 'adjusted', p_brand, 2 * size FROM q""",
    ),
}
