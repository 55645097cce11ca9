"""The given tables seen as inputs of the pipelines, once in Spark and once as SQL.

Each function derives one pipeline input from whole tables; ``SQL[name]`` is the same relation as a
common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import truncated_to_hour
from ..functions.recode import Period

PERIODS = [Period("1996", 1995, 1997), Period("1999", 1998, 2000)]
BASELINE = "5-LOW"
RUNS = ["A", "N", "R"]
OTHERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
YEARS = [1996, 1998, 2000]
SLICES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4}
# (timeslice_id, hour start, hour end, month start, month end): plain, wrapping, null and empty bands
BANDS = [
    (1, 6, 10, 1, 12),
    (2, 10, 16, 10, 2),
    (3, 16, 22, 1, 12),
    (4, 22, 6, 11, 3),
    (5, 0, 24, None, 12),
    (6, 7, 7, 1, 12),
]
ZONES = {0: "CAN_BC", 1: "CA_SCE", 2: "WA_E", 3: "UT_S", 4: "CO_E"}
STATES = {0: "CA", 1: "WA", 2: "CO", 3: "CAN", 4: "AZ"}
TECHS = {
    "PROMO": "Battery_Storage",
    "ECONOMY": "CCGT",
    "LARGE": "Hydro_NonPumped",
    "MEDIUM": "Central_PV",
    "SMALL": "Wind",
    "STANDARD": "Coal_Steam_Turbine",
}
FUELS = {
    "anvil": "Coal",
    "bolt": "Bio_Gas",
    "gear": "Bio_Solid",
    "gizmo": "DistillateFuelOil",
    "plate": "Waste_Heat",
    "ring": "Water",
    "rod": "Wind",
    "widget": "Solar",
}
WEIGHT_CATEGORIES = ["click", "error", "purchase", "signup", "view"]


_scans: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Scan of a given table; its footer is read once per session."""
    key = (spark.sparkContext.applicationId, id(spark), sf, name)
    if key not in _scans:
        _scans[key] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _scans[key]


def choose(c: Column | str, mapping: dict) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    expr = F
    for k, v in mapping.items():
        expr = expr.when(c == k, v)
    return expr.otherwise(None)


def sql_choose(c: str, mapping: dict) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


def shape(df: DataFrame, keys: list[str], values: dict[str, int] | None = None) -> DataFrame:
    """Comparable output: whole numbers as bigint, dates and times as text, measures rounded."""
    columns = []
    for k in keys:
        kind = df.schema[k].dataType
        c = F.col(k)
        if isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        columns.append(c.alias(k))
    columns += [(F.round(F.col(v), n) + F.lit(0.0)).alias(v) for v, n in (values or {}).items()]
    return df.select(*columns)


#: Relations that several others of a query read.
READ_OFTEN = {"results", "points", "series", "loads_year", "dispatch_year"}


def with_sql(names: str, select: str) -> str:
    """Select over the named relations and everything they build on, in definition order."""
    needed, queue = set(), names.split()
    while queue:
        n = queue.pop()
        if n not in needed:
            needed.add(n)
            queue += DEPENDS.get(n, "").split()
    parts = [f"{n} AS {'MATERIALIZED ' * (n in READ_OFTEN)}({SQL[n]})" for n in SQL if n in needed]
    return f"WITH {', '.join(parts)} {select}"


# ---- daily temperatures -------------------------------------------------------------------------


def temperatures(spark: SparkSession, sf: str) -> DataFrame:
    """Daily extremes per order status (scenario) and priority (zone), scaled to degrees."""
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("Scenario"),
            F.col("o_orderpriority").alias("load_zone"),
            F.col("o_orderdate").cast("date").alias("Date"),
        )
        .agg((F.min("o_totalprice") / 20000).alias("Tmin"), (F.max("o_totalprice") / 20000).alias("Tmax"))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("load_zone"), F.col("o_orderdate").cast("date").alias("Date"))
        .agg((F.min("o_totalprice") / 20000).alias("Tmin"), (F.max("o_totalprice") / 20000).alias("Tmax"))
    )


# ---- hourly demand and load sensitivity ---------------------------------------------------------


def demand(spark: SparkSession, sf: str) -> DataFrame:
    zone = choose("event_type", {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4})
    hour = truncated_to_hour("ts")
    return (
        table(spark, sf, "events")
        .groupBy(zone.alias("load_zone_id"), hour.alias("timestamp_utc"))
        .agg(F.sum("value").alias("demand_mw"))
        .select(
            "load_zone_id",
            F.lit(115).alias("demand_scenario_id"),
            F.timestamp_diff("HOUR", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("timestamp_utc")).alias(
                "raw_timepoint_id"
            ),
            F.concat(F.lit("Z"), F.col("load_zone_id").cast("string")).alias("load_zone_name"),
            "timestamp_utc",
            "demand_mw",
        )
    )


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        BANDS,
        "timeslice_id int, hour_of_day_start int, hour_of_day_end int, month_start int, month_end int",
    )


def source_slopes(spark: SparkSession, sf: str) -> DataFrame:
    """Mean balance per customer nation, segment (timeslice) and sign class (degree-day type)."""
    return (
        table(spark, sf, "customer")
        .groupBy(
            F.col("c_nationkey").alias("source_zone_id"),
            F.coalesce(choose("c_mktsegment", SLICES), F.lit(5)).alias("timeslice_id"),
            F.when(F.col("c_acctbal") >= 4000, "CDD").otherwise("HDD").alias("type_degree_days"),
        )
        .agg((F.avg("c_acctbal") / 100).alias("response_mw_per_delta_dd"))
    )


def fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each customer nation's lines that each supplier region delivers."""
    lines = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    flows = lines.groupBy(
        F.col("c_nationkey").alias("source_zone_id"), F.col("n_regionkey").alias("load_zone_id")
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = flows.groupBy("source_zone_id").agg(F.sum("n").alias("total"))
    return flows.join(totals, "source_zone_id").select(
        "source_zone_id",
        "load_zone_id",
        F.concat(F.lit("Z"), F.col("load_zone_id").cast("string")).alias("load_zone_name"),
        (F.col("n") / F.col("total")).alias("population_fraction"),
    )


def event_temperatures(spark: SparkSession, sf: str) -> DataFrame:
    zone = choose("event_type", {"click": "Z0", "error": "Z1", "purchase": "Z2", "signup": "Z3", "view": "Z4"})
    scenario = F.when(F.col("user_id") < 50, "S1").when(F.col("user_id") < 100, "S2").otherwise("S3")
    return (
        table(spark, sf, "events")
        .groupBy(zone.alias("load_zone"), scenario.alias("Scenario"), F.col("ts").cast("date").alias("Date"))
        .agg((F.min("value") / 10).alias("Tmin"), (F.max("value") / 10).alias("Tmax"))
    )


# ---- sampling -----------------------------------------------------------------------------------


def ship_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities per return flag (run), line status (zone) and ship hour."""
    hour = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("zone"), hour.alias("timestamp_utc"))
        .agg(F.sum("l_quantity").alias("demand_mw"))
        .withColumn(
            "raw_timepoint_id",
            F.timestamp_diff("HOUR", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("timestamp_utc")),
        )
    )


# ---- hydropower ---------------------------------------------------------------------------------


def generation(spark: SparkSession, sf: str, reference: bool) -> DataFrame:
    keys = [
        F.concat(F.lit("G"), F.col("l_suppkey").cast("string")).alias("generator_name"),
        F.year("l_shipdate").alias("Year"),
        F.month("l_shipdate").alias("Month"),
    ]
    lines = table(spark, sf, "lineitem").where(F.col("l_linestatus") == ("O" if reference else "F"))
    if not reference:
        keys.insert(0, F.col("l_returnflag").alias("scenario"))
    return lines.groupBy(*keys).agg(F.sum("l_quantity").alias("Generation_GWh"))


def generator_mapping(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return supplier.select(
        F.concat(F.lit("G"), F.col("s_suppkey").cast("string")).alias("generator_name"),
        F.col("s_suppkey").alias("project"),
        F.col("n_name").alias("load_zone_name"),
        F.when(F.col("s_acctbal") > 8500, "Hydro_Pumped").otherwise("Hydro_NonPumped").alias("gen_tech"),
        F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("not_generating"),
    )


def projects(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return supplier.select(
        F.col("s_suppkey").alias("GENERATION_PROJECT"),
        F.col("n_name").alias("gen_load_zone"),
        ((F.col("s_acctbal") + 1000) / 499).alias("gen_capacity_limit_mw"),
        F.lit(0.05).alias("gen_scheduled_outage_rate"),
        F.when(F.col("s_acctbal") > 5000, 0.1).otherwise(0.02).alias("gen_forced_outage_rate"),
    )


def nearest_zones(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    other = nation.select((F.col("n_nationkey") - 1).alias("_key"), F.col("n_name").alias("nearest_zone_with_hydro"))
    return (
        nation.where(F.col("n_regionkey") == 0)
        .join(other, F.col("n_nationkey") == F.col("_key"))
        .select(F.col("n_name").alias("zone_without_hydro"), "nearest_zone_with_hydro")
    )


def hydro_series(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("hydro_project"), F.date_format("l_shipdate", "yyyy'_M'MM").alias("timeseries")
    ).agg(
        (F.sum("l_extendedprice") / 9973).alias("hydro_avg_flow_mw"),
        (F.min("l_extendedprice") / 9973).alias("hydro_min_flow_mw"),
    )


def month_timepoints(spark: SparkSession, sf: str) -> DataFrame:
    """First order date of every month and priority."""
    firsts = table(spark, sf, "orders").groupBy(
        "o_orderpriority", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")
    ).agg(F.min("o_orderdate").alias("first"))
    return firsts.select(
        F.date_format("first", "yyyyMMdd").cast("int").alias("timepoint_id"),
        F.date_format("first", "yyyyMMdd'00'").alias("timestamp"),
        F.date_format("first", "'SAMP_'yyyy'_'MM").alias("timeseries"),
    )


# ---- electricity for water ----------------------------------------------------------------------


def part_word() -> Column:
    return F.substring_index("p_name", " ", -1)


def part_kind() -> Column:
    return F.when(F.col("p_type").isin("ECONOMY", "LARGE", "PROMO"), "Demand Site").otherwise("Diversion")


def word_zone(word: Column) -> Column:
    return F.when(word < "gizmo", "Z0").when(word < "rod", "Z1").otherwise("Z2")


def exports(spark: SparkSession, sf: str, reference: bool) -> DataFrame:
    lines = (
        table(spark, sf, "lineitem")
        .where(F.col("l_linestatus") == ("O" if reference else "F"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    keys = [
        part_kind().alias("file_kind"),
        part_word().alias("object_name"),
        F.year("l_shipdate").alias("Year"),
        F.month("l_shipdate").alias("Month"),
    ]
    if not reference:
        keys.insert(0, F.col("l_returnflag").alias("scenario"))
    return lines.groupBy(*keys).agg((F.sum("l_quantity") / 10000).alias("GWh"))


def object_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .select(
            part_kind().alias("file_kind"),
            part_word().alias("object_name"),
            F.lower(part_kind()).alias("sector"),
            F.when(part_word() == "anvil", "None").otherwise("Pumping").alias("included_energy"),
            word_zone(part_word()).alias("load_zone"),
        )
        .distinct()
        .withColumn("load_zone_id", F.substring("load_zone", 2, 1).cast("int"))
    )


def water_timepoints(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    return (
        table(spark, sf, "lineitem")
        .select(
            F.date_format(hour, "yyyyMMddHH").alias("timestamp"), F.date_format(hour, "'TS_'yyyy'_'MM").alias("timeseries")
        )
        .distinct()
        .withColumn("timepoint_id", F.col("timestamp").cast("int"))
    )


def water_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return (
        water_timepoints(spark, sf)
        .groupBy(F.col("timeseries").alias("TIMESERIES"))
        .agg(
            F.substring(F.max("timeseries"), 4, 4).cast("int").alias("ts_period"),
            F.lit(1.0).alias("ts_duration_of_tp"),
            F.count(F.lit(1)).alias("ts_num_tps"),
            (F.count(F.lit(1)) / 10).alias("ts_scale_to_period"),
        )
    )


def hourly_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each event type's value per hour of day, one column per type."""
    hourly = table(spark, sf, "events").groupBy("event_type", F.hour("ts").alias("Hour")).agg(F.sum("value").alias("_sum"))
    share = F.col("_sum") / F.sum("_sum").over(Window.partitionBy("event_type"))
    return hourly.withColumn("_share", share).groupBy("Hour").pivot("event_type", WEIGHT_CATEGORIES).agg(F.first("_share"))


SECTOR_CATEGORY = {"Demand Site": "click", "Diversion": "view"}


def sector_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return (
        object_mapping(spark, sf)
        .select("sector", "included_energy", "file_kind")
        .distinct()
        .withColumn("hour_weighting_category", choose("file_kind", SECTOR_CATEGORY))
    )


def loads(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(word_zone(part_word()).alias("LOAD_ZONE"), F.date_format(hour, "yyyyMMddHH").cast("int").alias("TIMEPOINT"))
        .agg((F.sum("l_extendedprice") / 10000).alias("zone_demand_mw"))
    )


# ---- scenario results ---------------------------------------------------------------------------


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their scenario, zone, technology and fuel; the source of all result tables."""
    word = F.substring_index("p_name", " ", -1)
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderpriority").alias("Scenario"),
            "o_orderstatus",
            "o_custkey",
            "s_nationkey",
            choose("n_regionkey", ZONES).alias("gen_load_zone"),
            choose("p_type", TECHS).alias("gen_tech"),
            choose(word, FUELS).alias("gen_energy_source"),
            F.col("l_partkey").alias("GENERATION_PROJECT"),
            "l_shipdate",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            (F.col("l_quantity") + F.col("l_extendedprice") / 99991).alias("amount"),
        )
    )


def gen_cap(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select(
        "Scenario",
        F.year("l_shipdate").alias("PERIOD"),
        "GENERATION_PROJECT",
        "gen_load_zone",
        "gen_tech",
        "gen_energy_source",
        F.col("amount").alias("GenCapacity"),
    )


def builds(spark: SparkSession, sf: str) -> DataFrame:
    return (
        results(spark, sf)
        .groupBy(
            "Scenario",
            F.col("GENERATION_PROJECT").alias("GEN_BLD_YRS_1"),
            F.year("l_shipdate").alias("GEN_BLD_YRS_2"),
        )
        .agg(F.sum("amount").alias("BuildGen"))
    )


def part_projects(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.when(F.col("p_size") < 17, "CAN_BC").when(F.col("p_size") < 34, "CA_SCE").otherwise("WA_E")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("GENERATION_PROJECT"),
        choose("p_type", TECHS).alias("gen_tech"),
        choose(F.substring_index("p_name", " ", -1), FUELS).alias("gen_energy_source"),
        zone.alias("gen_load_zone"),
    )


def annual_summary(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).select(
        "Scenario",
        "gen_load_zone",
        "gen_tech",
        "gen_energy_source",
        F.year("l_shipdate").alias("period"),
        (F.col("l_extendedprice") / 1000).alias("Energy_GWh_typical_yr"),
        F.col("l_tax").alias("VariableOMCost_per_yr"),
    )


def ship_hour() -> Column:
    return F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))


def load_balance(spark: SparkSession, sf: str) -> DataFrame:
    return (
        results(spark, sf)
        .groupBy(
            "Scenario",
            F.col("gen_load_zone").alias("load_zone"),
            F.date_format(ship_hour(), "yyyyMMddHH").alias("timestamp"),
        )
        .agg(
            (-F.sum("amount")).alias("zone_demand_mw"),
            (F.sum("l_extendedprice") / 10000).alias("ZoneTotalCentralDispatch"),
            (F.sum("l_tax") / 7 + 1).alias("TXPowerNet"),
            (F.sum("l_discount") / 7 + 1).alias("StorageNetCharge"),
        )
    )


def all_timepoints(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(
            F.date_format(ship_hour(), "yyyyMMddHH").alias("timestamp"),
            F.date_format(ship_hour(), "'TS_'yyyy'_'MM").alias("timeseries"),
        )
        .distinct()
        .withColumn("timepoint_id", F.col("timestamp").cast("int"))
    )


def all_timeseries(spark: SparkSession, sf: str) -> DataFrame:
    return (
        all_timepoints(spark, sf)
        .groupBy(F.col("timeseries").alias("TIMESERIES"))
        .agg(
            F.substring(F.max("timeseries"), 4, 4).cast("int").alias("ts_period"),
            F.lit(2.0).alias("ts_duration_of_tp"),
            F.count(F.lit(1)).alias("ts_num_tps"),
            (F.count(F.lit(1)) / 10).alias("ts_scale_to_period"),
        )
    )


def costs(spark: SparkSession, sf: str) -> DataFrame:
    component = choose("o_orderstatus", {"F": "FuelCosts", "O": "GenCosts", "P": "EmissionsCosts"})
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("Scenario"),
            F.year("o_orderdate").alias("PERIOD"),
            component.alias("Component"),
            F.lit("annual").alias("Component_type"),
        )
        .agg(
            F.sum("o_totalprice").alias("AnnualCost_Real"),
            (F.sum("o_totalprice") - F.count(F.lit(1)) * 1000).alias("AnnualCost_NPV"),
        )
    )


def dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return (
        results(spark, sf)
        .groupBy(
            "Scenario",
            "gen_load_zone",
            "gen_tech",
            "gen_energy_source",
            F.year("l_shipdate").alias("period"),
            F.date_format(ship_hour(), "yyyyMMddHH").alias("timestamp"),
            F.when(F.dayofmonth("l_shipdate") == 15, 1.0).otherwise(29.0).alias("tp_weight_in_year_hrs"),
        )
        .agg(
            F.sum("amount").alias("DispatchGen_MW"),
            (F.sum("l_discount") + F.sum("amount") / 997).alias("Curtailment_MW"),
        )
    )


def transmission(spark: SparkSession, sf: str) -> DataFrame:
    """Lines between the customer's and the supplier's nation."""
    flows = results(spark, sf).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    lz1, lz2 = F.col("c_nationkey").cast("string"), F.col("s_nationkey").cast("string")
    quantity = F.sum("l_quantity")
    return flows.groupBy(
        "Scenario",
        F.concat(lz1, F.lit("-"), lz2).alias("TRANSMISSION_LINE"),
        F.year("l_shipdate").alias("PERIOD"),
        lz1.alias("trans_lz1"),
        lz2.alias("trans_lz2"),
    ).agg(
        F.sum("l_discount").alias("existing_trans_cap"),
        F.when(quantity < 50, ".").otherwise(quantity.cast("int").cast("string")).alias("BuildTx"),
        (F.sum("l_extendedprice") / 1000).alias("TxCapacityNameplate"),
    )


def nation_zones(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("LOAD_ZONE"), F.col("n_nationkey").alias("zone_dbid"))


def nation_centroids(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("X"), F.count(F.lit(1)).alias("Y")
    )
    return (
        table(spark, sf, "nation")
        .join(customers, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(F.col("n_name").alias("LOAD_AREA"), "X", "Y")
    )


def zone_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One point per zone: count and mean balance of the region's suppliers."""
    joined = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.groupBy(choose("n_regionkey", ZONES).alias("LOAD_AREA")).agg(
        F.count(F.lit(1)).alias("X"), F.countDistinct("s_nationkey").alias("Y")
    )


# ---- catchment climate --------------------------------------------------------------------------


def catchment_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines by customer segment (scenario; open lines are the historical run), supplier nation
    (catchment) and part size (elevation band)."""
    band = (
        F.when(F.col("p_size") < 17, "0.to.1000.m")
        .when(F.col("p_size") < 34, "1000.to.2000.m")
        .otherwise("2000.to.3000.m")
    )
    return (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.when(F.col("l_linestatus") == "O", "Hist").otherwise(F.col("c_mktsegment")).alias("Scenario"),
            F.col("n_nationkey").cast("string").alias("Catchment_num"),
            F.concat_ws("_", choose("n_regionkey", STATES), "n_name").alias("Catchment_name"),
            choose("n_regionkey", STATES).alias("State"),
            band.alias("Elevation"),
            F.year("l_shipdate").alias("Year"),
            F.month("l_shipdate").alias("Month"),
            "l_quantity",
            "l_discount",
        )
    )


def catchment_data(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["Scenario", "Catchment_num", "Catchment_name", "State", "Year", "Month", "Elevation"]
    monthly = (
        catchment_lines(spark, sf)
        .groupBy(*keys)
        .agg((F.avg("l_discount") * (100 / 7)).alias("tavg.C"), F.sum("l_quantity").alias("Prcp.mm"))
    )
    return monthly.unpivot(keys, ["`tavg.C`", "`Prcp.mm`"], "Var_type", "value").withColumn(
        "Var_type", F.replace("Var_type", F.lit("`"), F.lit(""))
    )


def catchment_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Areas from the number of lines per catchment and band, the same in every scenario."""
    keys = ["Catchment_num", "Catchment_name", "State"]
    lines = catchment_lines(spark, sf)
    areas = lines.groupBy(*keys, "Elevation").agg((F.count(F.lit(1)) * 100.0).alias("area_ha"))
    totals = areas.groupBy(*keys).agg((F.sum("area_ha") * 0.01).alias("total_catchment_area_km2"))
    scenarios = lines.select("Scenario", *keys).distinct()
    return areas.join(totals, keys).join(scenarios, keys)


PART_WORD = "split_part(p_name, ' ', 2)"
PART_KIND = "CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'PROMO') THEN 'Demand Site' ELSE 'Diversion' END"
WORD_ZONE = f"CASE WHEN {PART_WORD} < 'gizmo' THEN 'Z0' WHEN {PART_WORD} < 'rod' THEN 'Z1' ELSE 'Z2' END"

SQL = {
    "temps": """SELECT o_orderstatus AS Scenario, o_orderpriority AS load_zone, CAST(o_orderdate AS DATE) AS Date,
        min(o_totalprice) / 20000 AS Tmin, max(o_totalprice) / 20000 AS Tmax FROM orders GROUP BY 1, 2, 3""",
    "hist": """SELECT o_orderpriority AS load_zone, CAST(o_orderdate AS DATE) AS Date,
        min(o_totalprice) / 20000 AS Tmin, max(o_totalprice) / 20000 AS Tmax FROM orders GROUP BY 1, 2""",
    "dd": """SELECT Scenario, load_zone, Date,
        greatest(0, round((65 - 32) / 1.8 - (Tmax + Tmin) / 2, 2)) AS HDD,
        greatest(0, round((Tmax + Tmin) / 2 - (65 - 32) / 1.8, 2)) AS CDD FROM temps""",
    "hist_dd": """SELECT load_zone, Date,
        greatest(0, round((65 - 32) / 1.8 - (Tmax + Tmin) / 2, 2)) AS HDD,
        greatest(0, round((Tmax + Tmin) / 2 - (65 - 32) / 1.8, 2)) AS CDD FROM hist""",
    "clim": """SELECT month(Date) AS m, day(Date) AS d, load_zone, 'HDD' AS degree_day_type,
          avg(HDD) AS hist_avg_degree_day_C FROM hist_dd WHERE Date >= DATE '1995-01-01' AND Date < DATE '1998-01-01' GROUP BY 1, 2, 3
        UNION ALL SELECT month(Date), day(Date), load_zone, 'CDD', avg(CDD) FROM hist_dd
          WHERE Date >= DATE '1995-01-01' AND Date < DATE '1998-01-01' GROUP BY 1, 2, 3""",
    "dd_long": """SELECT Scenario, load_zone, Date, 'HDD' AS degree_day_type, HDD AS degree_day_C FROM dd
        UNION ALL SELECT Scenario, load_zone, Date, 'CDD', CDD FROM dd""",
    "delta_daily": """SELECT a.*, b.hist_avg_degree_day_C, a.degree_day_C - b.hist_avg_degree_day_C AS delta_degree_day_C
        FROM dd_long a LEFT JOIN clim b ON b.m = month(a.Date) AND b.d = day(a.Date) AND a.load_zone = b.load_zone
          AND a.degree_day_type = b.degree_day_type
        WHERE a.Date >= DATE '1998-01-01' AND a.Date < DATE '2071-01-01'""",
    "demand": """SELECT load_zone_id, 115 AS demand_scenario_id, CAST(epoch(h) / 3600 AS BIGINT) AS raw_timepoint_id,
        'Z' || load_zone_id AS load_zone_name, h AS timestamp_utc, demand_mw FROM (
          SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS load_zone_id,
            date_trunc('hour', ts) AS h, sum(value) AS demand_mw FROM events GROUP BY 1, 2)""",
    "bands": """SELECT * FROM (VALUES (1, 6, 10, 1, 12), (2, 10, 16, 10, 2), (3, 16, 22, 1, 12), (4, 22, 6, 11, 3),
        (5, 0, 24, NULL, 12), (6, 7, 7, 1, 12)) t(timeslice_id, hs, he, ms, me)""",
    "source_slopes": f"""SELECT c_nationkey AS source_zone_id, coalesce({sql_choose("c_mktsegment", SLICES)}, 5) AS timeslice_id,
        CASE WHEN c_acctbal >= 4000 THEN 'CDD' ELSE 'HDD' END AS type_degree_days,
        avg(c_acctbal) / 100 AS response FROM customer GROUP BY 1, 2, 3""",
    "fractions": """SELECT source_zone_id, load_zone_id, 'Z' || load_zone_id AS load_zone_name,
        n / sum(n) OVER (PARTITION BY source_zone_id) AS fraction FROM (
          SELECT c_nationkey AS source_zone_id, n_regionkey AS load_zone_id, count(*) AS n
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)""",
    "zone_slopes": """SELECT load_zone_id, load_zone_name, timeslice_id, type_degree_days, sum(response * fraction) AS slope
        FROM source_slopes JOIN fractions USING (source_zone_id) GROUP BY 1, 2, 3, 4""",
    "band_map": """SELECT timeslice_id, raw_timepoint_id FROM bands,
          (SELECT DISTINCT raw_timepoint_id, timestamp_utc - INTERVAL 8 HOUR AS t FROM demand)
        WHERE ((hs < he AND hour(t) >= hs AND hour(t) < he) OR (hs > he AND (hour(t) >= hs OR hour(t) < he)))
          AND ((ms < me AND month(t) >= ms AND month(t) <= me)
            OR (ms > me AND (month(t) >= ms OR month(t) <= me)) AND ms IS NOT NULL)""",
    "response": """SELECT a.raw_timepoint_id, a.timestamp_utc, c.timeslice_id, a.load_zone_id, a.load_zone_name,
        b.type_degree_days, b.slope FROM demand a
        JOIN zone_slopes b ON a.load_zone_id = b.load_zone_id AND a.load_zone_name = b.load_zone_name
        JOIN band_map c ON a.raw_timepoint_id = c.raw_timepoint_id AND b.timeslice_id = c.timeslice_id
        WHERE a.demand_scenario_id = 115""",
    "event_temps": """SELECT CASE event_type WHEN 'click' THEN 'Z0' WHEN 'error' THEN 'Z1' WHEN 'purchase' THEN 'Z2' WHEN 'signup' THEN 'Z3' ELSE 'Z4' END AS load_zone,
        CASE WHEN user_id < 50 THEN 'S1' WHEN user_id < 100 THEN 'S2' ELSE 'S3' END AS Scenario, CAST(ts AS DATE) AS Date,
        min(value) / 10 AS Tmin, max(value) / 10 AS Tmax FROM events GROUP BY 1, 2, 3""",
    "event_dd": """SELECT Scenario, load_zone, Date, 'HDD' AS type_degree_days,
          greatest(0, round((65 - 32) / 1.8 - (Tmax + Tmin) / 2, 2)) AS v FROM event_temps
        UNION ALL SELECT Scenario, load_zone, Date, 'CDD',
          greatest(0, round((Tmax + Tmin) / 2 - (65 - 32) / 1.8, 2)) FROM event_temps""",
    "event_daily": """SELECT Scenario, load_zone, Date, type_degree_days,
        v - avg(v) OVER (PARTITION BY load_zone, type_degree_days) AS delta FROM event_dd""",
    "change": """SELECT r.*, CAST(r.timestamp_utc AS DATE) AS timestamp_date, d.delta, d.Scenario AS climate_scenario,
        r.slope * d.delta AS added_demand_mw FROM response r JOIN event_daily d ON r.load_zone_name = d.load_zone
          AND CAST(r.timestamp_utc AS DATE) = d.Date AND r.type_degree_days = d.type_degree_days""",
    "net": """SELECT raw_timepoint_id, timestamp_utc, timestamp_date, load_zone_id, load_zone_name, climate_scenario,
        sum(added_demand_mw) AS net FROM change GROUP BY 1, 2, 3, 4, 5, 6""",
    "adjusted": """SELECT a.raw_timepoint_id, a.timestamp_utc, a.load_zone_id, a.load_zone_name, a.demand_mw AS baseline_load_mw,
        b.net AS net_added_demand_mw, a.demand_mw + b.net AS final_demand_mw, b.climate_scenario
        FROM demand a JOIN net b ON a.load_zone_id = b.load_zone_id AND a.load_zone_name = b.load_zone_name
          AND a.raw_timepoint_id = b.raw_timepoint_id AND a.timestamp_utc = b.timestamp_utc""",
    "ship_load": """SELECT l_returnflag AS run, l_shipdate + l_linenumber * INTERVAL 1 HOUR AS ts, sum(l_quantity) AS mw
        FROM lineitem GROUP BY 1, 2""",
    "ship_days": """SELECT run, year(ts) AS y, month(ts) AS m, CAST(ts AS DATE) AS date, avg(mw) AS mean FROM ship_load GROUP BY 1, 2, 3, 4""",
    "peaks": """SELECT run, y, m, date FROM (SELECT run, year(ts) AS y, month(ts) AS m, CAST(ts AS DATE) AS date,
        row_number() OVER (PARTITION BY run, year(ts), month(ts) ORDER BY mw DESC, ts) AS rn FROM ship_load) WHERE rn = 1""",
    "medians": """SELECT run, y, m, date FROM (SELECT *, row_number() OVER (PARTITION BY run, y, m ORDER BY dist, date) AS rn FROM (
        SELECT *, round(abs(mean - quantile_cont(mean, 0.5) OVER (PARTITION BY run, y, m)), 9) AS dist FROM ship_days)) WHERE rn = 1""",
    "sampled": """SELECT * FROM (
        SELECT run, ts, mw, date, y, m, strftime(date, '%Y-%m-%d') || '_P' AS id, CASE y WHEN 1996 THEN 1 ELSE 2 END AS period_id
          FROM ship_load JOIN peaks USING (run) WHERE CAST(ts AS DATE) = date AND y IN (1996, 1999)
        UNION ALL SELECT run, ts, mw, date, y, m, strftime(date, '%Y-%m-%d') || '_M', CASE y WHEN 1996 THEN 1 ELSE 2 END
          FROM (SELECT l.*, d.date, d.y, d.m, row_number() OVER (PARTITION BY run, d.date ORDER BY ts) AS rn
            FROM ship_load l JOIN medians d USING (run) WHERE CAST(ts AS DATE) = date AND y IN (1996, 1999)) WHERE (rn - 1) % 2 = 0)""",
    "weighted": """SELECT *, (3 * 24 * no_days) / (1.0 * num_timepoints) AS scaling_to_period FROM (
        SELECT *, CASE WHEN id LIKE '%P' THEN 1 ELSE day(last_day(date)) - 1 END AS no_days,
          count(*) OVER (PARTITION BY run, period_id, id) AS num_timepoints,
          min(ts) OVER (PARTITION BY run, period_id, id) AS first_ts, max(ts) OVER (PARTITION BY run, period_id, id) AS last_ts
        FROM sampled)""",
    "ref_gen": """SELECT 'G' || l_suppkey AS generator_name, year(l_shipdate) AS Year, month(l_shipdate) AS Month, sum(l_quantity) AS gwh
        FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2, 3""",
    "run_gen": """SELECT l_returnflag AS scenario, 'G' || l_suppkey AS generator_name, year(l_shipdate) AS Year, month(l_shipdate) AS Month,
        sum(l_quantity) AS gwh FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2, 3, 4""",
    "ref_mean": """SELECT generator_name, Month, avg(gwh) AS ref_gwh FROM ref_gen WHERE Year BETWEEN 1995 AND 2000 GROUP BY 1, 2""",
    "run_pos": """SELECT *, row_number() OVER (PARTITION BY scenario, generator_name ORDER BY Year, Month) AS p FROM run_gen
        WHERE Year BETWEEN 1995 AND 2001""",
    "run_avg": """SELECT a.scenario, a.generator_name, a.Year AS period, a.Month, avg(b.gwh) AS cc_gwh FROM run_pos a JOIN run_pos b
          ON a.scenario = b.scenario AND a.generator_name = b.generator_name AND abs(a.p - b.p) <= 24 AND (a.p - b.p) % 12 = 0
        WHERE a.Year IN (1996, 1998, 2000) GROUP BY 1, 2, 3, 4""",
    "ratios": """SELECT a.*, b.ref_gwh, CASE WHEN b.ref_gwh = 0 THEN 1 ELSE a.cc_gwh / b.ref_gwh END AS ratio
        FROM run_avg a LEFT JOIN ref_mean b USING (generator_name, Month)""",
    "mapped": """SELECT r.*, s_suppkey AS project, n_name AS load_zone_name FROM ratios r
        JOIN supplier ON generator_name = 'G' || s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE s_acctbal <= 8500 AND s_acctbal >= 0""",
    "zone_ratios": """SELECT scenario, period, Month, load_zone_name, avg(ratio) AS ratio FROM mapped GROUP BY 1, 2, 3, 4""",
    "hydro": """SELECT l_suppkey AS hydro_project, strftime(l_shipdate, '%Y_M%m') AS timeseries, year(l_shipdate) AS y, month(l_shipdate) AS m,
        sum(l_extendedprice) / 9973 AS avg_flow, min(l_extendedprice) / 9973 AS min_flow FROM lineitem
        GROUP BY 1, 2, 3, 4""",
    "proj": """SELECT s_suppkey AS project, n_name AS zone, (s_acctbal + 1000) / 499 AS cap,
        1 - (0.05 + CASE WHEN s_acctbal > 5000 THEN 0.1 ELSE 0.02 END) AS avail FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "nearest": """SELECT a.n_name AS zone, b.n_name AS near FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_regionkey = 0""",
    "applied": """SELECT s.scenario, h.*, p.cap, p.avail, coalesce(n.near, p.zone) AS lookup_zone, coalesce(o.ratio, z.ratio) AS ratio,
        h.avg_flow * coalesce(o.ratio, z.ratio) AS avg_cc, h.min_flow * coalesce(o.ratio, z.ratio) AS min_cc
        FROM hydro h JOIN (SELECT DISTINCT l_returnflag AS scenario FROM lineitem) s ON true
        LEFT JOIN mapped o ON o.scenario = s.scenario AND o.project = h.hydro_project AND o.period = h.y AND o.Month = h.m
        LEFT JOIN proj p ON p.project = h.hydro_project LEFT JOIN nearest n ON n.zone = p.zone
        LEFT JOIN zone_ratios z ON z.scenario = s.scenario AND z.period = h.y AND z.Month = h.m AND z.load_zone_name = coalesce(n.near, p.zone)""",
    "clamped": """SELECT scenario, hydro_project, timeseries, y, m, cap,
        CASE WHEN avg_flow / cap > avail AND avg_cc / cap > avail THEN avg_flow * avail WHEN avg_cc / cap > avail THEN cap * avail ELSE avg_cc END AS avg_cc,
        CASE WHEN avg_flow / cap > avail AND avg_cc / cap > avail THEN min_flow * avail WHEN avg_cc / cap > avail THEN cap / 2 * avail ELSE min_cc END AS min_cc
        FROM applied""",
    "ref_use": f"""SELECT {PART_KIND} AS file_kind, {PART_WORD} AS object_name, year(l_shipdate) AS Year, month(l_shipdate) AS Month, sum(l_quantity) / 10000 AS gwh
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'O' GROUP BY 1, 2, 3, 4""",
    "run_use": f"""SELECT l_returnflag AS scenario, {PART_KIND} AS file_kind, {PART_WORD} AS object_name, year(l_shipdate) AS Year, month(l_shipdate) AS Month,
        sum(l_quantity) / 10000 AS gwh FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1, 2, 3, 4, 5""",
    "ref_use_pos": """SELECT *, row_number() OVER (PARTITION BY file_kind, object_name ORDER BY Year, Month) AS p FROM ref_use WHERE Year BETWEEN 1995 AND 2001""",
    "run_use_pos": """SELECT *, row_number() OVER (PARTITION BY scenario, file_kind, object_name ORDER BY Year, Month) AS p FROM run_use WHERE Year BETWEEN 1995 AND 2001""",
    "ref_use_avg": """SELECT a.file_kind, a.object_name, a.Year, a.Month, avg(b.gwh) AS gwh FROM ref_use_pos a JOIN ref_use_pos b
          ON a.file_kind = b.file_kind AND a.object_name = b.object_name AND abs(a.p - b.p) <= 24 AND (a.p - b.p) % 12 = 0
        WHERE a.Year IN (1996, 1998, 2000) GROUP BY 1, 2, 3, 4""",
    "run_use_avg": """SELECT a.scenario, a.file_kind, a.object_name, a.Year, a.Month, avg(b.gwh) AS gwh FROM run_use_pos a JOIN run_use_pos b
          ON a.scenario = b.scenario AND a.file_kind = b.file_kind AND a.object_name = b.object_name AND abs(a.p - b.p) <= 24 AND (a.p - b.p) % 12 = 0
        WHERE a.Year IN (1996, 1998, 2000) GROUP BY 1, 2, 3, 4, 5""",
    "objects": f"""SELECT DISTINCT {PART_KIND} AS file_kind, {PART_WORD} AS object_name, lower({PART_KIND}) AS sector,
        CASE WHEN {PART_WORD} = 'anvil' THEN 'None' ELSE 'Pumping' END AS included_energy, {WORD_ZONE} AS load_zone FROM part""",
    "use_delta": """SELECT s.scenario, r.Year, r.Month, day(last_day(make_date(r.Year, r.Month, 1))) AS dim, o.load_zone, r.file_kind, o.sector, o.included_energy,
        CASE WHEN count(c.gwh) = count(*) THEN sum(c.gwh) END AS cc, sum(r.gwh) AS ref,
        CASE WHEN count(c.gwh) = count(*) THEN sum(c.gwh - r.gwh) END AS delta
        FROM ref_use_avg r JOIN (SELECT DISTINCT scenario FROM run_use) s ON true
        LEFT JOIN objects o ON o.file_kind = r.file_kind AND o.object_name = r.object_name
        LEFT JOIN run_use_avg c ON c.scenario = s.scenario AND c.file_kind = r.file_kind AND c.object_name = r.object_name AND c.Year = r.Year AND c.Month = r.Month
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""",
    "points": """SELECT DISTINCT strftime(l_shipdate + l_linenumber * INTERVAL 1 HOUR, '%Y%m%d%H') AS timestamp,
        strftime(l_shipdate + l_linenumber * INTERVAL 1 HOUR, 'TS_%Y_%m') AS timeseries FROM lineitem""",
    "series": """SELECT timeseries, CAST(substr(max(timeseries), 4, 4) AS INTEGER) AS ts_period, count(*) / 10 AS scale FROM points GROUP BY 1""",
    "weights": f"""SELECT hour(ts) AS h, event_type AS category, sum(value) / max(total) AS w FROM events
        JOIN (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) USING (event_type) GROUP BY 1, 2""",
    "hourly_delta": f"""SELECT scenario, CAST(timestamp AS INTEGER) AS timepoint_id, load_zone,
        CASE WHEN count(share) = count(*) THEN sum(share) END AS delta FROM (
          SELECT u.scenario, p.timestamp, u.load_zone, u.delta / u.dim * w.w AS share FROM points p
          JOIN use_delta u ON u.Year = CAST(substr(p.timestamp, 1, 4) AS INTEGER) AND u.Month = CAST(substr(p.timestamp, 5, 2) AS INTEGER)
          LEFT JOIN weights w ON w.h = CAST(substr(p.timestamp, 9, 2) AS INTEGER)
            AND w.category = {sql_choose("u.file_kind", SECTOR_CATEGORY)}
          WHERE u.included_energy <> 'None') GROUP BY 1, 2, 3""",
    "zone_load": f"""SELECT {WORD_ZONE} AS LOAD_ZONE,
        CAST(strftime(l_shipdate + l_linenumber * INTERVAL 1 HOUR, '%Y%m%d%H') AS INTEGER) AS TIMEPOINT, sum(l_extendedprice) / 10000 AS mw
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "guarded": """SELECT s.scenario, l.LOAD_ZONE, l.TIMEPOINT, l.mw, CASE WHEN l.mw + d.delta * 1000 < 0 THEN l.mw ELSE l.mw + d.delta * 1000 END AS new_mw
        FROM zone_load l JOIN (SELECT DISTINCT l_returnflag AS scenario FROM lineitem) s ON true
        LEFT JOIN hourly_delta d ON d.scenario = s.scenario AND d.load_zone = l.LOAD_ZONE AND d.timepoint_id = l.TIMEPOINT""",
    "results": f"""SELECT o_orderpriority AS Scenario, o_orderstatus, o_custkey, s_nationkey, {sql_choose("n_regionkey", ZONES)} AS gen_load_zone,
        {sql_choose("p_type", TECHS)} AS gen_tech, {sql_choose("split_part(p_name, ' ', 2)", FUELS)} AS fuel,
        CASE WHEN p_type = 'PROMO' THEN 'Battery Storage' ELSE CASE split_part(p_name, ' ', 2) WHEN 'anvil' THEN 'Coal' WHEN 'bolt' THEN 'Biomass'
          WHEN 'gear' THEN 'Biomass' WHEN 'gizmo' THEN 'Oil' WHEN 'plate' THEN 'Waste Heat' WHEN 'ring' THEN 'Water' WHEN 'rod' THEN 'Wind'
          WHEN 'widget' THEN 'Solar' END END AS source,
        l_partkey, p_size, l_shipdate, year(l_shipdate) AS y, strftime(l_shipdate + l_linenumber * INTERVAL 1 HOUR, '%Y%m%d%H') AS stamp,
        l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_quantity + l_extendedprice / 99991 AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "cap_zone": """SELECT Scenario, y AS PERIOD, gen_load_zone, source, sum(amount) AS mw FROM results GROUP BY 1, 2, 3, 4""",
    "cap_delta": """SELECT a.Scenario, '5-LOW' AS Baseline_Scenario, a.PERIOD, a.gen_load_zone, a.source, a.mw, b.mw AS base_mw
        FROM cap_zone a LEFT JOIN cap_zone b ON b.Scenario = '5-LOW' AND a.PERIOD = b.PERIOD AND a.gen_load_zone = b.gen_load_zone AND a.source = b.source
        WHERE a.Scenario <> '5-LOW'""",
    "build_zone": """SELECT Scenario, CASE WHEN p_size < 17 THEN 'CAN_BC' WHEN p_size < 34 THEN 'CA_SCE' ELSE 'WA_E' END AS zone,
        CASE WHEN y BETWEEN 1995 AND 1997 THEN '1996' WHEN y BETWEEN 1998 AND 2000 THEN '1999' WHEN y > 2000 THEN '2055' ELSE 'earlier' END AS PERIOD,
        source, sum(amount) AS mw FROM results GROUP BY 1, 2, 3, 4""",
    "build_delta": """SELECT a.Scenario, a.zone, a.PERIOD, a.source, a.mw, b.mw AS base_mw FROM build_zone a LEFT JOIN build_zone b
        ON b.Scenario = '5-LOW' AND a.zone = b.zone AND a.PERIOD = b.PERIOD AND a.source = b.source WHERE a.Scenario <> '5-LOW'""",
    "balance": """SELECT Scenario, gen_load_zone AS load_zone, stamp, CAST(substr(stamp, 1, 4) AS INTEGER) AS Year, CAST(substr(stamp, 5, 2) AS INTEGER) AS Month,
        -sum(amount) AS demand, sum(l_extendedprice) / 10000 AS central, sum(l_tax) / 7 + 1 AS tx, sum(l_discount) / 7 + 1 AS storage
        FROM results GROUP BY 1, 2, 3""",
    "loads_year": """SELECT b.Scenario, b.load_zone, b.Year, s.ts_period, sum(demand * scale / 5 * 2) / 1000 AS demand, sum(central * scale / 5 * 2) / 1000 AS central,
        sum(tx * scale / 5 * 2) / 1000 AS tx, sum(storage * scale / 5 * 2) / 1000 AS storage FROM balance b JOIN points p ON b.stamp = p.timestamp
        JOIN series s ON p.timeseries = s.timeseries GROUP BY 1, 2, 3, 4""",
    "dispatch_year": """SELECT Scenario, gen_load_zone, y AS period, source, sum(l_extendedprice / 1000) AS gwh, sum(l_tax) AS om FROM results GROUP BY 1, 2, 3, 4""",
    "gen_load": """SELECT Scenario, period AS ts_period, source AS energy_category, sum(gwh) AS gwh FROM dispatch_year GROUP BY 1, 2, 3
        UNION ALL SELECT Scenario, ts_period, 'zone_demand_GWh', sum(demand) FROM loads_year GROUP BY 1, 2
        UNION ALL SELECT Scenario, ts_period, 'ZoneTotalCentralDispatch_GWh', sum(central) FROM loads_year GROUP BY 1, 2
        UNION ALL SELECT Scenario, ts_period, 'TXPowerNet_GWh', sum(tx) FROM loads_year GROUP BY 1, 2
        UNION ALL SELECT Scenario, ts_period, 'StorageNetCharge_GWh', sum(storage) FROM loads_year GROUP BY 1, 2""",
    "cost_items": """SELECT o_orderpriority AS Scenario, year(o_orderdate) AS PERIOD, CASE o_orderstatus WHEN 'F' THEN 'FuelCosts' WHEN 'O' THEN 'GenCosts' END AS Component,
        sum(o_totalprice) * 5 AS real, (sum(o_totalprice) - count(*) * 1000) * 5 AS npv FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3""",
    "cost_delta": """SELECT a.*, b.real AS real_b, b.npv AS npv_b FROM cost_items a LEFT JOIN cost_items b ON b.Scenario = '5-LOW' AND a.PERIOD = b.PERIOD
        AND a.Component = b.Component WHERE a.Scenario <> '5-LOW'""",
    "month_load": """SELECT b.Scenario, b.load_zone, b.Month, b.Year, s.ts_period, sum(demand * scale / 5) AS demand, sum(central * scale / 5) AS central
        FROM balance b JOIN points p ON b.stamp = p.timestamp JOIN series s ON p.timeseries = s.timeseries GROUP BY 1, 2, 3, 4, 5""",
    "month_delta": """SELECT a.Scenario, a.load_zone, a.Month, a.Year, a.ts_period, a.demand, b.demand AS demand_b, a.central, b.central AS central_b
        FROM month_load a LEFT JOIN month_load b ON b.Scenario = '5-LOW' AND a.load_zone = b.load_zone AND a.Month = b.Month AND a.Year = b.Year
          AND a.ts_period = b.ts_period WHERE a.Scenario <> '5-LOW'""",
    "system_month": """SELECT Scenario, Month, Year, ts_period, CASE WHEN count(demand_b) = count(*) THEN -sum(demand_b) END AS base, -sum(demand) AS demand
        FROM month_delta GROUP BY 1, 2, 3, 4""",
    "hour_zone": """SELECT Scenario, gen_load_zone, source, y AS period, stamp, CASE WHEN day(l_shipdate) = 15 THEN 'peak_day' ELSE 'median_day' END AS day_type,
        CASE WHEN day(l_shipdate) = 15 THEN 1 ELSE 29 END AS w, sum(amount) AS mw, CASE WHEN source IN ('Solar', 'Wind') THEN sum(l_discount) + sum(amount) / 997 ELSE 0 END AS curt
        FROM results GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "hour_system": """SELECT Scenario, source, period, stamp, day_type, w, CAST(substr(stamp, 5, 2) AS INTEGER) AS Month,
        hour((strptime(stamp, '%Y%m%d%H') AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles') + 1 AS Hour_local,
        sum(mw) AS mw, sum(curt) AS curt FROM hour_zone GROUP BY 1, 2, 3, 4, 5, 6""",
    "season_mean": """SELECT Scenario, CASE WHEN Month IN (3, 4, 5) THEN 'Spring' WHEN Month IN (6, 7, 8) THEN 'Summer' WHEN Month IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS Season,
        period, Hour_local, day_type, source, avg(mw) AS mw, avg(curt) AS curt FROM hour_system GROUP BY 1, 2, 3, 4, 5, 6""",
    "seasonal": """SELECT Scenario, Season, period, Hour_local, day_type, source, mw FROM season_mean
        UNION ALL SELECT Scenario, Season, period, Hour_local, day_type, 'Curtailment', sum(curt) FROM season_mean GROUP BY 1, 2, 3, 4, 5""",
    "season_delta": """SELECT a.*, b.mw AS base FROM seasonal a LEFT JOIN seasonal b ON b.Scenario = '5-LOW' AND a.Season = b.Season AND a.period = b.period
        AND a.Hour_local = b.Hour_local AND a.day_type = b.day_type AND a.source = b.source WHERE a.Scenario <> '5-LOW'""",
    "hydro_month": """SELECT Scenario, period, Month, sum(w * mw) AS mwh FROM hour_system WHERE source = 'Water' GROUP BY 1, 2, 3""",
    "hydro_month_delta": """SELECT a.Scenario, a.period, a.Month, a.mwh, b.mwh AS base, a.mwh - b.mwh AS delta FROM hydro_month a LEFT JOIN hydro_month b
        ON b.Scenario = '5-LOW' AND a.period = b.period AND a.Month = b.Month WHERE a.Scenario <> '5-LOW'""",
    "tx": """SELECT Scenario, c_nationkey || '-' || s_nationkey AS line, y AS PERIOD, CAST(c_nationkey AS VARCHAR) AS lz1, CAST(s_nationkey AS VARCHAR) AS lz2,
        sum(l_discount) AS existing, CASE WHEN sum(l_quantity) < 50 THEN 0 ELSE sum(l_quantity) END AS built, sum(l_extendedprice) / 1000 AS nameplate
        FROM results JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4, 5""",
    "tx_system": """SELECT Scenario, PERIOD, sum(built) AS built, sum(nameplate) AS nameplate FROM tx GROUP BY 1, 2""",
    "tx_all": """SELECT Scenario, PERIOD, built, nameplate, sum(built) OVER (PARTITION BY Scenario ORDER BY PERIOD) AS cumulative, nameplate - built AS existing FROM tx_system""",
    "tx_types": """SELECT Scenario, PERIOD, 'New Tx Capacity Built' AS Tx_type, built AS mw FROM tx_all
        UNION ALL SELECT Scenario, PERIOD, 'Total Tx Nameplate Capacity', nameplate FROM tx_all
        UNION ALL SELECT Scenario, PERIOD, 'Cumulative New Tx Capacity Built', cumulative FROM tx_all
        UNION ALL SELECT Scenario, PERIOD, 'Existing Tx Capacity', existing FROM tx_all""",
    "catch": f"""SELECT CASE WHEN l_linestatus = 'O' THEN 'Hist' ELSE c_mktsegment END AS Scenario, CAST(n_nationkey AS VARCHAR) AS num,
        {sql_choose("n_regionkey", STATES)} || '_' || n_name AS name, {sql_choose("n_regionkey", STATES)} AS state,
        CASE n_regionkey WHEN 1 THEN 'PacNW' WHEN 2 THEN 'MT' WHEN 3 THEN 'CAN' ELSE 'SW' END AS region,
        CASE WHEN p_size < 17 THEN 0 WHEN p_size < 34 THEN 1 ELSE 2 END AS band,
        year(l_shipdate) AS y, month(l_shipdate) AS m, l_quantity, l_discount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "catch_month": """SELECT c.Scenario, c.num, c.name, c.state, c.region, y, m, avg(t) AS tavg, sum(mm * 1e-6 * area * 0.01) AS km3, max(total) AS km2 FROM (
          SELECT Scenario, num, name, state, region, band, y, m, avg(l_discount) * (100.0::DOUBLE / 7) AS t, sum(l_quantity) AS mm FROM catch GROUP BY 1, 2, 3, 4, 5, 6, 7, 8) c
        JOIN (SELECT num, band, count(*) * 100.0 AS area FROM catch GROUP BY 1, 2) b ON b.num = c.num AND b.band = c.band
        JOIN (SELECT num, count(*) * 100.0 * 0.01 AS total FROM catch GROUP BY 1) k ON k.num = c.num
        WHERE CASE WHEN c.Scenario = 'Hist' THEN y BETWEEN 1995 AND 1997 ELSE y BETWEEN 1995 AND 2001 END GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "catch_pos": """SELECT *, row_number() OVER (PARTITION BY Scenario, num ORDER BY y, m) AS p, count(*) OVER (PARTITION BY Scenario, num) AS n FROM catch_month""",
    "catch_avg": """SELECT a.Scenario, a.num, a.name, a.state, a.region, a.y, a.m, a.km2, a.tavg, a.km3, avg(b.tavg) AS avg_t, avg(b.km3) AS avg_km3
        FROM catch_pos a JOIN catch_pos b ON a.Scenario = b.Scenario AND a.num = b.num AND abs(a.p - b.p) <= 24 AND (a.p - b.p) % 12 = 0 AND b.p < b.n
        WHERE a.Scenario <> 'Hist' GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10
        UNION ALL SELECT Scenario, num, name, state, region, y, m, km2, tavg, km3, tavg, km3 FROM catch_pos WHERE Scenario = 'Hist'""",
    "hist_year": """SELECT num, region, avg(t) AS t, sum(k) AS k, km2 FROM (SELECT num, region, m, km2, avg(avg_t) AS t, avg(avg_km3) AS k FROM catch_avg
        WHERE Scenario = 'Hist' GROUP BY 1, 2, 3, 4) GROUP BY num, region, km2""",
    "cc_year": """SELECT Scenario, num, region, y, km2, avg(avg_t) AS t, sum(avg_km3) AS k FROM catch_avg WHERE Scenario <> 'Hist' GROUP BY 1, 2, 3, 4, 5""",
}

DEPENDS = {
    "dd": "temps",
    "hist_dd": "hist",
    "clim": "hist_dd",
    "dd_long": "dd",
    "delta_daily": "dd_long clim",
    "zone_slopes": "source_slopes fractions",
    "band_map": "bands demand",
    "response": "demand zone_slopes band_map",
    "event_dd": "event_temps",
    "event_daily": "event_dd",
    "change": "response event_daily",
    "net": "change",
    "adjusted": "demand net",
    "ship_days": "ship_load",
    "peaks": "ship_load",
    "medians": "ship_days",
    "sampled": "ship_load peaks medians",
    "weighted": "sampled",
    "ref_mean": "ref_gen",
    "run_pos": "run_gen",
    "run_avg": "run_pos",
    "ratios": "run_avg ref_mean",
    "mapped": "ratios",
    "zone_ratios": "mapped",
    "applied": "hydro mapped proj nearest zone_ratios",
    "clamped": "applied",
    "ref_use_pos": "ref_use",
    "run_use_pos": "run_use",
    "ref_use_avg": "ref_use_pos",
    "run_use_avg": "run_use_pos",
    "use_delta": "ref_use_avg run_use run_use_avg objects",
    "series": "points",
    "hourly_delta": "points use_delta weights",
    "guarded": "zone_load hourly_delta",
    "cap_zone": "results",
    "cap_delta": "cap_zone",
    "build_zone": "results",
    "build_delta": "build_zone",
    "balance": "results",
    "loads_year": "balance points series",
    "dispatch_year": "results",
    "gen_load": "dispatch_year loads_year",
    "cost_delta": "cost_items",
    "month_load": "balance points series",
    "month_delta": "month_load",
    "system_month": "month_delta",
    "hour_zone": "results",
    "hour_system": "hour_zone",
    "season_mean": "hour_system",
    "seasonal": "season_mean",
    "season_delta": "seasonal",
    "hydro_month": "hour_system",
    "hydro_month_delta": "hydro_month",
    "tx": "results",
    "tx_system": "tx",
    "tx_all": "tx_system",
    "tx_types": "tx_all",
    "catch_month": "catch",
    "catch_pos": "catch_month",
    "catch_avg": "catch_pos",
    "hist_year": "catch_avg",
    "cc_year": "catch_avg",
}
