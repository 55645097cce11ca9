"""Readers for tables and headered CSV files, one scan for all scenarios and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..quality import complete_rows
from .lines import cells, decoded_path, file_lines, first_lines, path_part, trimmed

# Result files of a run directory and the columns used from each.
RESULT_COLUMNS: dict[str, dict[str, str]] = {
    "outputs/gen_cap.csv": {
        "PERIOD": "int",
        "GENERATION_PROJECT": "string",
        "gen_load_zone": "string",
        "gen_tech": "string",
        "gen_energy_source": "string",
        "GenCapacity": "double",
    },
    "outputs/BuildGen.csv": {"GEN_BLD_YRS_1": "string", "GEN_BLD_YRS_2": "int", "BuildGen": "double"},
    "inputs/generation_projects_info.csv": {
        "GENERATION_PROJECT": "string",
        "gen_tech": "string",
        "gen_energy_source": "string",
        "gen_load_zone": "string",
        "gen_capacity_limit_mw": "double",
        "gen_scheduled_outage_rate": "double",
        "gen_forced_outage_rate": "double",
    },
    "outputs/dispatch_zonal_annual_summary.csv": {
        "gen_load_zone": "string",
        "gen_tech": "string",
        "gen_energy_source": "string",
        "period": "int",
        "Energy_GWh_typical_yr": "double",
        "VariableOMCost_per_yr": "double",
    },
    "outputs/load_balance.csv": {
        "load_zone": "string",
        "timestamp": "string",
        "zone_demand_mw": "double",
        "ZoneTotalCentralDispatch": "double",
        "TXPowerNet": "double",
        "StorageNetCharge": "double",
    },
    "inputs/timeseries.csv": {
        "TIMESERIES": "string",
        "ts_period": "int",
        "ts_duration_of_tp": "double",
        "ts_num_tps": "int",
        "ts_scale_to_period": "double",
    },
    "inputs/timepoints.csv": {"timepoint_id": "int", "timestamp": "string", "timeseries": "string"},
    "inputs/loads.csv": {"LOAD_ZONE": "string", "TIMEPOINT": "int", "zone_demand_mw": "double"},
    "inputs/hydro_timeseries.csv": {
        "hydro_project": "string",
        "timeseries": "string",
        "hydro_min_flow_mw": "double",
        "hydro_avg_flow_mw": "double",
    },
    "inputs/load_zones.csv": {"LOAD_ZONE": "string", "zone_dbid": "int", "zone_ccs_distance_km": "double"},
    "outputs/costs_itemized.csv": {
        "PERIOD": "int",
        "Component": "string",
        "Component_type": "string",
        "AnnualCost_Real": "double",
        "AnnualCost_NPV": "double",
    },
    "outputs/dispatch.csv": {
        "gen_load_zone": "string",
        "gen_tech": "string",
        "gen_energy_source": "string",
        "period": "int",
        "timestamp": "string",
        "DispatchGen_MW": "double",
        "Curtailment_MW": "double",
        "tp_weight_in_year_hrs": "double",
    },
    "outputs/transmission.csv": {
        "TRANSMISSION_LINE": "string",
        "PERIOD": "int",
        "trans_lz1": "string",
        "trans_lz2": "string",
        "existing_trans_cap": "double",
        "BuildTx": "string",
        "TxCapacityNameplate": "double",
        "TxCapacityNameplateAvailable": "double",
        "TotalAnnualCost": "double",
    },
}

DEMAND_COLUMNS = {
    "load_zone_id": "int",
    "demand_scenario_id": "int",
    "raw_timepoint_id": "int",
    "load_zone_name": "string",
    "timestamp_utc": "timestamp_ntz",
    "demand_mw": "double",
}


def read_columns(
    spark: SparkSession, glob: str | list[str], columns: dict[str, str], sep: str = ",", null: str = "NA"
) -> DataFrame:
    """Headered CSV files; the listed columns by the names in each file's own header, cast to the listed types.

    The headers are read from the first bytes of the files; one scan of all files then takes each cell from the place
    that its file's header gives the column. A line equal to its file's header is taken for the header. Empty cells,
    ``null`` and text that is not of the listed type become null; a listed column that a file lacks is null in its rows,
    and an error if no file has it. Records end with their line. The path of each file is kept as ``path``.
    """
    heads = first_lines(spark, glob, 1).select("file", F.col("head")[0].alias("header"))
    names = trimmed(cells(F.regexp_replace("header", "^\uFEFF", ""), sep))
    places = heads.select("file", "header", *[F.array_position(names, c).cast("int").alias(f"at_{i}") for i, c in enumerate(columns)])
    found = places.agg(F.count(F.lit(1)).alias("files"), *[F.max(f"at_{i}").alias(f"at_{i}") for i in range(len(columns))]).first()
    if not found.files:
        raise FileNotFoundError(f"no CSV file with a header in {glob}")
    if lacking := [c for i, c in enumerate(columns) if not found[f"at_{i}"]]:
        raise ValueError(f"no file has the columns {lacking}")
    rows = file_lines(spark, glob).join(places, "file").where(F.col("value") != F.col("header"))
    rows = rows.withColumn("_cells", cells(F.col("value"), sep))
    picked = []
    for i, (c, kind) in enumerate(columns.items()):
        cell = F.when(F.col(f"at_{i}") > 0, F.try_element_at("_cells", F.col(f"at_{i}")))
        picked.append(F.when((cell != "") & (cell != null), cell).try_cast(kind).alias(c))
    return rows.select(*picked, decoded_path(F.col("file")).alias("path"))


def read_degree_days(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """Daily degree-day files ``<scenario>/<zone>_CDD-HDD.csv``."""
    columns = {"Date": "date", "Tmin": "double", "Tmax": "double", "HDD": "double", "CDD": "double"}
    df = read_columns(spark, glob, columns)
    path = F.col("path")
    return df.withColumns(
        {
            "load_zone": F.regexp_extract(path_part(path, 1), "^(.*?)_CDD-HDD", 1),
            "Scenario": path_part(path, 2),
        }
    ).drop("path")


def read_results(
    spark: SparkSession, root: str, table: str, scenarios: DataFrame | None = None, complete: bool = False
) -> DataFrame:
    """One result table of every run directory below ``root``.

    Without ``scenarios`` the run directory is the scenario; with a (run_id, Scenario, ...) dimension
    only the listed runs are kept and its attributes are added.
    """
    columns = RESULT_COLUMNS[table]
    df = read_columns(spark, f"{root}/*/{table}", columns)
    run = path_part(F.col("path"), 3)
    if complete:
        df = complete_rows(df, list(columns))
    if scenarios is None:
        return df.withColumn("Scenario", run).drop("path")
    return df.withColumn("run_id", run).drop("path").join(scenarios, "run_id")


def read_table(
    spark: SparkSession, table: str, columns: list[str] | None = None, where: str | Column | None = None, **jdbc: str
) -> DataFrame:
    """Scan a Parquet path (or a JDBC table, with connection options) with pushed-down filter and columns."""
    if jdbc:
        df = spark.read.format("jdbc").options(dbtable=table, **jdbc).load()
    else:
        df = spark.read.parquet(table)
    if where is not None:
        df = df.where(where)
    return df if columns is None else df.select(*columns)


def read_demand(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """Exported demand series: the six leading columns, typed."""
    return read_columns(spark, glob, DEMAND_COLUMNS).drop("path")


def load_data(demand: DataFrame, demand_scenario_id: int) -> DataFrame:
    """Rows of one demand scenario with their calendar date as text."""
    return demand.where(F.col("demand_scenario_id") == demand_scenario_id).withColumn(
        "date", F.date_format("timestamp_utc", "yyyy-MM-dd")
    )


def read_bulk_csv(
    spark: SparkSession, glob: str | list[str], schema: T.StructType, quote: str = '"', escape: str = "'"
) -> DataFrame:
    """Headered bulk-load file with declared types, quote and escape characters."""
    return spark.read.csv(glob, header=True, schema=schema, quote=quote, escape=escape)


def read_dimension(spark: SparkSession, glob: str | list[str], columns: dict[str, str]) -> DataFrame:
    """Mapping and dimension tables (also sheets saved as CSV)."""
    return read_columns(spark, glob, columns).drop("path")
