"""Registered queries: scenario comparison, climate, general operators, quality checks, sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import quality
from ..functions import recode
from ..functions.calendar import hour_bin, season_of
from ..functions.units import thousandth
from ..operators import delta as de
from ..operators import grouped, matching, ordered, reshape
from ..plans import climate as cl
from ..plans import compare as co
from ..session import scratch
from ..sources import sinks
from ..sources.parameters import COMBINED_FAMILY, COOLING_FAMILY, WATER_FAMILY
from ..sources.tables import read_table
from . import inputs as i
from .inputs import BASELINE, shape, table, with_sql

# ---- scenario results ---------------------------------------------------------------------------


def _capacity(spark, sf):
    return co.capacity_online(i.gen_cap(spark, sf), BASELINE)


def q_capacity_online_zone(spark, sf):
    keys = ["Scenario", "PERIOD", "gen_load_zone", "gen_energy_source"]
    return shape(_capacity(spark, sf)["zone"], keys, {"GenCapacityCumulative_MW": 2, "Total_Lz_GenCap_MW": 2})


def _snake(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.replace(" ", "_") for c in df.columns})


def q_capacity_online_wide(spark, sf):
    wide = _snake(_capacity(spark, sf)["system_wide"])
    return shape(wide, ["Scenario", "PERIOD"], {s.replace(" ", "_"): 2 for s in recode.ENERGY_SOURCES})


def q_capacity_online_delta(spark, sf):
    keys = ["Scenario", "Baseline_Scenario", "PERIOD", "gen_load_zone", "gen_energy_source"]
    values = {
        "GenCapacityCumulative_MW": 2,
        "GenCapacityCumulative_MW_baseline": 2,
        "Total_Lz_GenCap_MW_baseline": 2,
        "Delta_GenCapacity_MW": 2,
        "GenCap_perc_change_from_baseline": 3,
    }
    return shape(_capacity(spark, sf)["zone_delta"], keys, values)


def q_capacity_online_system_delta(spark, sf):
    keys = ["Scenario", "Baseline_Scenario", "PERIOD", "gen_energy_source"]
    values = {
        "GenCapacityOnline_MW": 2,
        "GenCapacityOnline_MW_baseline": 2,
        "Delta_GenCapacity_MW": 2,
        "GenCap_perc_change_from_baseline": 3,
    }
    return shape(_capacity(spark, sf)["system_delta"], keys, values)


def _built(spark, sf):
    return co.capacity_built(i.builds(spark, sf), i.part_projects(spark, sf), BASELINE, i.PERIODS, "earlier")


def q_capacity_built_delta(spark, sf):
    keys = ["Scenario", "PERIOD", "gen_load_zone", "gen_energy_source"]
    values = {
        "BuildGen_MW": 2,
        "BuildGen_MW_baseline": 2,
        "Delta_BuildGen_MW": 2,
        "BuildGen_perc_change_from_baseline": 3,
    }
    return shape(_built(spark, sf)["zone_delta"], keys, values)


def q_capacity_built_cumulative(spark, sf):
    keys = ["Scenario", "gen_energy_source", "scenario_rank"]
    values = {
        "CumulativeDelta_BuildGen_MW": 2,
        "CumulativeBuildGen_MW": 2,
        "CumulativeBaselineBuildGen_MW": 2,
        "TotalCumulativeDelta_BuildGen_MW": 2,
    }
    return shape(_built(spark, sf)["cumulative"], keys, values)


def _loads(spark, sf):
    return co.annual_loads(i.load_balance(spark, sf), i.all_timepoints(spark, sf), i.all_timeseries(spark, sf))


def _dispatch(spark, sf):
    return co.annual_dispatch(i.annual_summary(spark, sf), _loads(spark, sf), BASELINE)


def q_annual_loads(spark, sf):
    keys = ["Scenario", "load_zone", "Year", "ts_period"]
    return shape(_loads(spark, sf)["zone"], keys, {c: 5 for c in co.LOAD_CATEGORIES})


def q_annual_dispatch(spark, sf):
    keys = ["Scenario", "gen_load_zone", "period", "gen_energy_source"]
    values = {"Energy_GWh_typical_yr": 5, "VariableCost_per_yr": 5, "Total_annual_GWh": 5}
    return shape(_dispatch(spark, sf)["zone"], keys, values)


def q_annual_dispatch_system_delta(spark, sf):
    keys = ["Scenario", "period", "gen_energy_source"]
    values = {
        "Energy_GWh_typical_yr": 5,
        "Energy_GWh_typical_yr_baseline": 5,
        "Delta_AnnualGen_GWh": 5,
        "AnnualGen_perc_change_from_baseline": 3,
    }
    return shape(_dispatch(spark, sf)["system_delta"], keys, values)


def q_gen_load_wide(spark, sf):
    wide = _snake(_dispatch(spark, sf)["gen_load_wide"])
    columns = recode.ENERGY_SOURCES + co.LOAD_CATEGORIES
    return shape(wide, ["Scenario", "ts_period"], {c.replace(" ", "_"): 5 for c in columns})


def q_gen_load_delta(spark, sf):
    keys = ["Scenario", "ts_period", "energy_category"]
    values = {
        "Energy_GWh_typical_yr": 5,
        "Energy_GWh_typical_yr_baseline": 5,
        "Delta_AnnualGen_GWh": 5,
        "AnnualGen_perc_change_from_baseline": 3,
    }
    return shape(_dispatch(spark, sf)["gen_load_delta"], keys, values)


def q_gen_load_zone_delta(spark, sf):
    keys = ["Scenario", "load_zone", "ts_period", "energy_category"]
    values = {
        "Energy_GWh_typical_yr": 5,
        "Energy_GWh_typical_yr_baseline": 5,
        "Delta_AnnualGen_GWh": 5,
        "AnnualGen_perc_change_from_baseline": 3,
    }
    return shape(_dispatch(spark, sf)["gen_load_zone_delta"], keys, values)


def _family_deltas(spark: SparkSession, sf: str, zones: bool = False) -> DataFrame:
    """Energy by category and zone with the order status as impact family, against the baseline."""
    family = i.choose("o_orderstatus", {"F": WATER_FAMILY, "O": COOLING_FAMILY, "P": COMBINED_FAMILY})
    source = recode.normalise_source("gen_energy_source", "gen_tech")
    category = F.when(source == "Wind", "zone_demand_GWh").otherwise(source)
    sign = F.when(source == "Wind", -1.0).otherwise(1.0)
    keys = ["load_zone"] if zones else []
    energy = (
        i.results(spark, sf)
        .groupBy(
            family.alias("climate_impacts_included"),
            "Scenario",
            F.year("l_shipdate").alias("ts_period"),
            category.alias("energy_category"),
            *[F.col("gen_load_zone").alias(k) for k in keys],
        )
        .agg(F.sum(F.col("l_extendedprice") / 1000 * sign).alias("Energy_GWh_typical_yr"))
    )
    keys = ["climate_impacts_included", "ts_period", "energy_category", *keys]
    return co.demand_positive_delta(energy, keys, BASELINE)


def q_load_hydro_disaggregation(spark, sf):
    parts = co.load_hydro_disaggregation(_family_deltas(spark, sf, zones=True))
    keys = ["Scenario", "ts_period", "load_zone", "energy_category_disagg", "climate_impacts_included"]
    return shape(parts, keys, {"Delta_AnnualGen_GWh": 5, "AnnualGen_perc_change_from_baseline": 3})


def q_imbalance_ranking(spark, sf):
    ranked = co.imbalance_ranking(co.load_hydro_disaggregation(_family_deltas(spark, sf)), 1998)
    keys = ["Scenario", "ts_period", "energy_category_disagg", "scenario_rank"]
    return shape(ranked, keys, {"Adj_Delta_AnnualGen_GWh": 5, "TotalImbalance_GWh": 5})


_FAMILY_SQL = """SELECT CASE o_orderstatus WHEN 'F' THEN 'Hydropower and Water Load Scenarios' WHEN 'O' THEN 'Cooling Load Scenarios'
      ELSE 'Cooling + Hydropower and Water Load Scenarios' END AS family, Scenario, y, {zone}
      CASE WHEN source = 'Wind' THEN 'zone_demand_GWh' ELSE source END AS category, sum(l_extendedprice / 1000) AS gwh FROM results GROUP BY ALL"""


def _disagg_sql(zone: str, select: str) -> str:
    match_zone = "AND a.load_zone = b.load_zone" if zone else ""
    energy = _FAMILY_SQL.format(zone="gen_load_zone AS load_zone," if zone else "")
    sql = with_sql("results", "@")
    return sql.replace(
        " @",
        f""", energy AS ({energy}), parts AS (SELECT a.*, b.gwh AS base, a.gwh - b.gwh AS d,
        CASE WHEN a.category = 'Water' THEN 'Water' WHEN a.family LIKE 'Hydropower%' THEN 'Water Load' ELSE 'Cooling Load' END AS cause
        FROM energy a LEFT JOIN energy b ON b.Scenario = '5-LOW' AND a.family = b.family AND a.y = b.y AND a.category = b.category {match_zone}
        WHERE a.Scenario <> '5-LOW' AND ((a.category = 'zone_demand_GWh' AND a.family NOT LIKE 'Cooling +%') OR (a.category = 'Water' AND a.family LIKE 'Cooling +%')))
        {select}""",
    )


LOAD_VALUES = {
    "zone_demand_GWh": 5,
    "zone_demand_GWh_baseline": 5,
    "Delta_zone_demand_GWh": 5,
    "AnnualLoad_perc_change_from_baseline": 3,
    "Delta_TXPowerNet_GWh": 6,
    "AnnualTxPowerNet_perc_change_from_baseline": 3,
}


def _load_delta(spark, sf):
    return co.load_dispatch_tx_delta(_loads(spark, sf)["zone"], BASELINE)


def q_load_delta_zone(spark, sf):
    return shape(_load_delta(spark, sf)["zone"], ["Scenario", "load_zone", "Year", "ts_period"], LOAD_VALUES)


def q_load_delta_system(spark, sf):
    return shape(_load_delta(spark, sf)["system"], ["Scenario", "Year", "ts_period"], LOAD_VALUES)


def q_load_delta_us(spark, sf):
    return shape(_load_delta(spark, sf)["us"], ["Scenario", "Year", "ts_period"], LOAD_VALUES)


def _load_delta_sql(keys: str, where: str, groups: str, joined: str) -> str:
    return with_sql("loads_year", "@").replace(
        " @",
        f""", d AS (SELECT a.Scenario, a.load_zone, a.Year, a.ts_period, a.demand, b.demand AS demand_b, a.tx, b.tx AS tx_b FROM loads_year a
          JOIN loads_year b ON b.Scenario = '5-LOW' AND a.load_zone = b.load_zone AND a.Year = b.Year AND a.ts_period = b.ts_period WHERE a.Scenario <> '5-LOW'),
        s AS (SELECT {keys}, sum(demand) AS demand, sum(demand_b) AS demand_b, sum(tx) AS tx, sum(tx_b) AS tx_b FROM d WHERE {where} GROUP BY ALL)
        SELECT {keys}, round(demand, 5) AS zone_demand_GWh, round(demand_b, 5) AS zone_demand_GWh_baseline, round(abs(demand) - abs(demand_b), 5) AS Delta_zone_demand_GWh,
          round((abs(demand) - abs(demand_b)) / abs(demand_b), 3) + 0.0 AS AnnualLoad_perc_change_from_baseline,
          round(tx - tx_b, 6) AS Delta_TXPowerNet_GWh, round((tx - tx_b) / tx_b, 3) + 0.0 AS AnnualTxPowerNet_perc_change_from_baseline FROM s""",
    )


def _costs(spark, sf):
    return co.cost_report(i.costs(spark, sf), BASELINE)


def q_cost_items_delta(spark, sf):
    values = {"PeriodCost_NPV": 2, "PeriodCost_Real": 2, "Delta_PeriodCost_NPV": 2, "Delta_PeriodCost_Real": 2,
              "PeriodCost_NPV_perc_change_from_baseline": 3}
    return shape(_costs(spark, sf)["item_delta"], ["Scenario", "PERIOD", "Component"], values)


def q_cost_period_delta(spark, sf):
    values = {"PeriodCost_NPV": 2, "PeriodCost_Real": 2, "Delta_PeriodCost_NPV": 2, "Delta_PeriodCost_Real": 2}
    return shape(_costs(spark, sf)["period_delta"], ["Scenario", "PERIOD"], values)


def q_cost_total_delta(spark, sf):
    values = {"PeriodCost_NPV": 2, "Delta_PeriodCost_NPV": 2, "Delta_PeriodCost_Real": 2,
              "TotalCost_NPV_perc_change_from_baseline": 8, "TotalCost_Real_perc_change_from_baseline": 8}
    return shape(_costs(spark, sf)["total_delta"], ["Scenario", "Baseline_Scenario"], values)


def _hourly(spark, sf):
    return co.hourly_loads(i.load_balance(spark, sf), i.all_timepoints(spark, sf), i.all_timeseries(spark, sf))


def _monthly(spark, sf):
    return co.monthly_load_delta(_hourly(spark, sf), BASELINE)


def q_monthly_load_delta(spark, sf):
    keys = ["Scenario", "load_zone", "Month", "Year", "ts_period"]
    values = {
        "zone_demand_mw": 3,
        "zone_demand_mw_baseline": 3,
        "Delta_zone_demand_mw": 3,
        "zone_demand_mw_perc_change_from_baseline": 3,
        "Delta_ZoneTotalCentralDispatch": 3,
    }
    known = _monthly(spark, sf)["zone"]
    return shape(known, keys, values)


def q_monthly_system_load_delta(spark, sf):
    keys = ["Scenario", "Month", "Year", "ts_period"]
    values = {"zone_demand_mw": 3, "zone_demand_mw_baseline": 3, "Delta_zone_demand_mw": 3, "Delta_perc_zone_demand_mw": 7}
    known = _monthly(spark, sf)["system"]
    return shape(known, keys, values)


def q_monthly_us_load_delta(spark, sf):
    keys = ["Scenario", "Month", "Year", "ts_period"]
    values = {"zone_demand_mw": 3, "zone_demand_mw_baseline": 3, "Delta_zone_demand_mw": 3, "Delta_perc_zone_demand_mw": 7}
    return shape(_monthly(spark, sf)["us"], keys, values)


def q_duration_curve(spark, sf):
    curve = co.system_duration_curve(_hourly(spark, sf))
    return shape(curve, ["Scenario", "ts_period", "timestamp", "counter"], {"zone_demand_mw": 2})


def q_order_value_curve(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    curve = ordered.duration_curve(orders, "o_totalprice", ["o_orderpriority"], ["o_orderkey"])
    return shape(curve, ["o_orderpriority", "o_orderkey", "counter"], {"o_totalprice": 2})


def _hour_dispatch(spark, sf):
    return co.hourly_dispatch(i.dispatch(spark, sf))


def q_hourly_dispatch(spark, sf):
    keys = ["Scenario", "gen_energy_source", "period", "Month", "Hour_UTC", "Hour_local", "day_type", "Season"]
    system = _hour_dispatch(spark, sf)["system"]
    summed = system.groupBy(*keys).agg(
        F.sum("DispatchGen_MW").alias("DispatchGen_MW"), F.sum("Curtailment_MW").alias("Curtailment_MW")
    )
    return shape(summed, keys, {"DispatchGen_MW": 2, "Curtailment_MW": 2})


def q_seasonal_dispatch(spark, sf):
    keys = ["Scenario", "Season", "period", "Hour_local", "day_type", "gen_energy_source"]
    return shape(co.seasonal_dispatch(_hour_dispatch(spark, sf)["system"]), keys, {"DispatchGen_MW": 5})


def _seasonal_delta(spark, sf, dense):
    seasonal = co.seasonal_dispatch(_hour_dispatch(spark, sf)["system"])
    return co.seasonal_dispatch_delta(seasonal, BASELINE, dense)


def q_seasonal_dispatch_delta(spark, sf):
    keys = ["Scenario", "Season", "period", "Hour_local", "day_type", "gen_energy_source"]
    known = _seasonal_delta(spark, sf, False)
    values = {"DispatchGen_MW": 5, "Delta_DispatchGen_MW": 5, "DispatchGen_perc_change_from_baseline": 3}
    return shape(known, keys, values)


def q_seasonal_dispatch_dense(spark, sf):
    keys = ["Scenario", "Season", "period", "Hour_local", "day_type", "gen_energy_source"]
    return shape(_seasonal_delta(spark, sf, True), keys, {"DispatchGen_MW": 5, "Delta_DispatchGen_MW": 5})


def q_focus_dispatch(spark, sf):
    """One scenario's peak days of one period, dense over the hours, sources and seasons that have a baseline."""
    chosen = co.focus_dispatch(_seasonal_delta(spark, sf, True), "1-URGENT", "peak_day", 1998)
    keys = ["Scenario", "Season", "period", "Hour_local", "day_type", "gen_energy_source"]
    return shape(chosen, keys, {"DispatchGen_MW": 5, "DispatchGen_MW_baseline": 5, "Delta_DispatchGen_MW": 5})


def q_hydro_monthly_delta(spark, sf):
    keys = ["Scenario", "period", "Month"]
    values = {"Monthly_DispatchGen_MW": 2, "Monthly_DispatchGen_MW_baseline": 2, "Delta_Monthly_DispatchGen_MW": 2,
              "PercDelta_Monthly_DispatchGen_MW": 8}
    return shape(co.hydro_monthly_delta(_hour_dispatch(spark, sf)["system"], BASELINE), keys, values)


def q_monthly_load_hydro_box(spark, sf):
    hydro = co.hydro_monthly_delta(_hour_dispatch(spark, sf)["system"], BASELINE)
    box = co.monthly_load_hydro_box(_monthly(spark, sf)["system"], hydro, 1998)["box"]
    values = {c: 4 for c in grouped.FIVE}
    return shape(box, ["Demand_or_Supply", "Month", "n"], values)


def _tx(spark, sf):
    return co.tx_report(i.transmission(spark, sf), BASELINE)


def q_tx_lines(spark, sf):
    keys = ["Scenario", "TRANSMISSION_LINE", "PERIOD"]
    return shape(_tx(spark, sf)["lines"], keys, {"BuildTx": 2, "cumulative_BuiltTx_MW": 2})


def q_tx_report(spark, sf):
    keys = ["Scenario", "PERIOD", "Tx_type"]
    return shape(_tx(spark, sf)["long"], keys, {"MW_Tx": 3})


def q_tx_delta(spark, sf):
    keys = ["Scenario", "Baseline_Scenario", "PERIOD", "Tx_type"]
    values = {"MW_Tx": 3, "MW_Tx_baseline": 3, "Delta_MW_Tx": 3, "Tx_perc_change_from_baseline": 3}
    return shape(_tx(spark, sf)["delta"], keys, values)


def q_tx_edges(spark, sf):
    edges = co.tx_edges(i.transmission(spark, sf), i.nation_zones(spark, sf), i.nation_centroids(spark, sf))
    keys = ["Scenario", "TRANSMISSION_LINE", "PERIOD", "zone_id1", "zone_id2", "LOAD_ZONE1", "LOAD_ZONE2", "Y1", "Y2"]
    values = {"X1": 4, "X2": 4, "nameplate_GW": 8, "BuildTx_GW": 8, "total_new_BuildTx_GW": 8}
    return shape(edges, keys, values)


def q_tx_edges_long(spark, sf):
    edges = co.tx_edges(i.transmission(spark, sf), i.nation_zones(spark, sf), i.nation_centroids(spark, sf))
    long = co.tx_edges_long(edges)
    return shape(long, ["Scenario", "TRANSMISSION_LINE", "PERIOD", "LOAD_ZONE1", "LOAD_ZONE2", "Tx_type"], {"Tx_GW": 8})


def _map_table(spark, sf):
    return co.zone_map_table(_capacity(spark, sf)["zone_delta"], i.zone_centroids(spark, sf), list(range(1995, 2003)))


def q_zone_map_table(spark, sf):
    keys = ["Scenario", "gen_load_zone", "gen_energy_source", "PERIOD", "X", "Y"]
    return shape(_map_table(spark, sf), keys, {"Delta_GenCapacity_MW": 2})


def q_zone_source_mix(spark, sf):
    mix = _snake(co.zone_source_mix(_map_table(spark, sf), "1-URGENT", 1998))
    sources = [s.replace(" ", "_") for s in recode.ENERGY_SOURCES if s != "Curtailment"]
    return shape(mix, ["PERIOD", "gen_load_zone", "X", "Y"], {**{s: 2 for s in sources}, "radius": 6})


# ---- climate ------------------------------------------------------------------------------------


def _climate(spark, sf):
    return cl.catchment_climate(
        i.catchment_data(spark, sf),
        i.catchment_bands(spark, sf),
        scenario_years=(1995, 2001),
        historical_years=(1995, 1997),
        half_width=2,
    )


def q_catchment_climate(spark, sf):
    known = _climate(spark, sf)
    values = {"tavg_C": 6, "Precip_km3": 9, "avg_tavg_C": 6, "avg_Precip_km3": 9, "total_catchment_area_km2": 2}
    return shape(known, ["Scenario", "Catchment_num", "Catchment_name", "Region", "Year", "Month"], values)


REGION_VALUES = {
    "delta_annual_avg_tavg_C": 6,
    "delta_annual_total_Precip_km3": 8,
    "annual_avg_tavg_C": 6,
    "annual_hist_avg_tavg_C": 6,
    "annual_total_Precip_km3": 8,
    "annual_hist_avg_Precip_km3": 8,
    "total_region_area_km2": 2,
}


def q_climate_delta_by_region(spark, sf):
    return shape(cl.climate_delta_by_region(_climate(spark, sf)), ["Scenario", "Year", "Region"], REGION_VALUES)


def q_climate_vs_energy_fit(spark, sf):
    """Energy deltas of the customer segments against the climate deltas of the same segments."""
    segments = i.results(spark, sf).join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    source = recode.normalise_source("gen_energy_source", "gen_tech")
    energy = segments.groupBy(
        F.col("c_mktsegment").alias("Scenario"),
        F.year("l_shipdate").alias("ts_period"),
        F.col("gen_load_zone").alias("load_zone"),
        source.alias("energy_category"),
        F.lit(COMBINED_FAMILY).alias("climate_impacts_included"),
        source.alias("energy_category_disagg"),
    ).agg((F.sum("l_extendedprice") / 1000).alias("Energy_GWh_typical_yr"))
    keys = ["ts_period", "load_zone", "energy_category", "climate_impacts_included", "energy_category_disagg"]
    deltas = de.scenario_delta(energy, "BUILDING", keys, co.ENERGY)
    fits = cl.climate_vs_energy_fit(deltas, cl.climate_delta_by_region(_climate(spark, sf)), 1998)["fits"]
    values = {"temp_r2": 6, "temp_slope": 4, "precip_r2": 6}
    return shape(fits, ["energy_category_disagg", "Region"], values)


# ---- general operators --------------------------------------------------------------------------


def _priority_years(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("Scenario"), F.year("o_orderdate").alias("y"), "o_orderstatus")
        .agg(F.sum("o_totalprice").alias("price"))
    )


def _delta_query(mode):
    def query(spark, sf):
        df = _priority_years(spark, sf)
        if mode == "abs":
            df = df.withColumn("price", -F.col("price"))
        d = de.scenario_delta(df, BASELINE, ["y", "o_orderstatus"], ["price"], mode)
        values = {"price": 2, "price_baseline": 2, "delta_price": 2, "price_perc_change_from_baseline": 3}
        return shape(d, ["Scenario", "Baseline_Scenario", "y", "o_orderstatus"], values)

    return query


def _delta_sql(delta: str, change: str, value: str = "sum(o_totalprice)") -> str:
    return f"""WITH s AS (SELECT o_orderpriority AS Scenario, year(o_orderdate) AS y, o_orderstatus, {value} AS v FROM orders GROUP BY 1, 2, 3)
        SELECT a.Scenario, b.Scenario AS Baseline_Scenario, a.y, a.o_orderstatus, round(a.v, 2) AS price, round(b.v, 2) AS price_baseline,
        round({delta}, 2) AS delta_price, round({change}, 3) + 0.0 AS price_perc_change_from_baseline
        FROM s a LEFT JOIN s b ON b.Scenario = '5-LOW' AND a.y = b.y AND a.o_orderstatus = b.o_orderstatus WHERE a.Scenario <> '5-LOW'"""


def q_scenario_delta_full(spark, sf):
    """Daily grain, where scenarios lack days of the baseline and the other way round."""
    daily = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("Scenario"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    d = de.scenario_delta(daily, BASELINE, ["day"], ["n"], how="full", scenarios=i.OTHERS)
    sides = d.groupBy("Scenario").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("n").alias("with_scenario"),
        F.count("n_baseline").alias("with_baseline"),
        F.count("delta_n").alias("with_both"),
    )
    return shape(sides, sides.columns)


def q_rollup_delta(spark, sf):
    d = de.scenario_delta(_priority_years(spark, sf), BASELINE, ["y", "o_orderstatus"], ["price"])
    rolled = de.rollup_delta(d, ["Scenario", "Baseline_Scenario", "y"], ["price"])
    values = {"price": 2, "price_baseline": 2, "delta_price": 2, "price_perc_change_from_baseline": 3}
    return shape(rolled, ["Scenario", "Baseline_Scenario", "y"], values)


def q_drop_undefined_change(spark, sf):
    """Cents above full prices are often equal on both sides; zero baselines give 0/0 or x/0."""
    counts = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("Scenario"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
        .agg(F.sum(F.when(F.col("o_totalprice") < 3500, 1.0).otherwise(0.0)).alias("n"))
    )
    d = de.scenario_delta(counts, BASELINE, ["y", "m"], ["n"])
    kept = de.drop_undefined_change(d, "n_perc_change_from_baseline")
    infinite = F.abs(F.col("n_perc_change_from_baseline")) == F.lit(float("inf"))
    return shape(
        kept.withColumn("kind", F.when(infinite, "infinite").otherwise("finite")), ["Scenario", "y", "m", "kind"], {"delta_n": 1}
    )


def q_running_total(spark, sf):
    monthly = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.sum("o_totalprice").alias("price"))
    )
    total = ordered.running_total(monthly, "price", ["o_orderpriority"], ["day"], "running_price")
    return shape(total, ["o_orderpriority", "day"], {"price": 2, "running_price": 2})


def q_group_fit(spark, sf):
    fit = grouped.group_fit(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag", "l_linestatus"])
    return shape(fit, ["l_returnflag", "l_linestatus"], {"r2": 8, "slope": 5, "intercept": 4})


def q_five_number(spark, sf):
    five = grouped.five_number(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return shape(five, ["l_returnflag", "n"], {c: 4 for c in grouped.FIVE})


def q_mixed_rollup(spark, sf):
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    mixed = grouped.mixed_rollup(joined, ["n_regionkey", "n_name"], {"c_acctbal": "mean_balance"}, {"c_custkey": "sum_keys"})
    return shape(mixed, ["n_regionkey", "n_name", "sum_keys"], {"mean_balance": 5})


def q_distinct_counts(spark, sf):
    counted = grouped.distinct_counts(
        table(spark, sf, "lineitem"), ["l_returnflag"], {"l_suppkey": "suppliers", "l_partkey": "parts"}
    )
    return shape(counted, counted.columns)


def q_category_rank(spark, sf):
    totals = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
    ranks = grouped.category_rank(totals, "o_orderpriority", "total")
    return shape(ranks, ["o_orderpriority", "category_rank"], {"total": 2})


def q_partition_total(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("price"))
    total = matching.with_total(sums, "price", ["o_orderpriority"], "priority_price")
    return shape(total, ["o_orderpriority", "o_orderstatus"], {"price": 2, "priority_price": 2})


def q_to_long(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"), F.avg("o_totalprice").alias("mean")
    )
    return shape(
        reshape.to_long(wide, ["o_orderpriority"], None, "statistic", "price"), ["o_orderpriority", "statistic"], {"price": 4}
    )


def q_pivot_fill(spark, sf):
    daily = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    wide = reshape.pivot_fill(daily, ["day", "o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return shape(wide, ["day", "o_orderpriority"], {"F": 2, "O": 2, "P": 2})


def q_pivot_nulls(spark, sf):
    """Absent combinations stay null."""
    daily = table(spark, sf, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    wide = reshape.pivot_fill(daily, ["day", "o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], fill=None)
    return shape(wide, ["day", "o_orderpriority"], {"F": 2, "O": 2, "P": 2})


def q_densify(spark, sf):
    daily = (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.sum("o_totalprice").alias("price"))
    )
    dense = matching.densify(daily, ["o_orderpriority", "o_orderstatus", "day"], {"price": 0.0})
    return shape(dense, ["o_orderpriority", "o_orderstatus", "day"], {"price": 2})


def q_recode_sources(spark, sf):
    tagged = i.results(spark, sf).select(
        recode.normalise_source("gen_energy_source", "gen_tech").alias("source"),
        recode.technology_group("gen_tech").alias("tech_group"),
        "l_quantity",
    )
    ranked = tagged.withColumn("group_rank", recode.rank_in("tech_group", recode.TECHNOLOGY_ORDER))
    total = ranked.groupBy("source", "tech_group", "group_rank").agg(F.sum("l_quantity").alias("quantity"))
    return shape(total, ["source", "tech_group", "group_rank"], {"quantity": 2})


def q_period_bins(spark, sf):
    label = recode.bin_period(F.year("o_orderdate"), i.PERIODS, "earlier", "later")
    counted = table(spark, sf, "orders").groupBy(label.alias("period"), season_of(F.month("o_orderdate")).alias("season")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("price")
    )
    return shape(counted, ["period", "season", "n"], {"price": 2})


def q_regions_and_hours(spark, sf):
    bins = hour_bin(F.hour("ts") + 1, 4)
    zone = i.choose("event_type", {"click": "CA_N", "error": "WA_E", "purchase": "UT_S", "signup": "CAN_BC", "view": "MEX_BAJA"})
    tagged = table(spark, sf, "events").select(zone.alias("zone"), bins.alias("hour_bin"), "value")
    us = tagged.where(recode.is_us_zone("zone"))
    summed = us.groupBy(recode.region_of(recode.state_of_zone("zone")).alias("region"), "hour_bin").agg(
        F.sum(thousandth("value")).alias("value_thousands")
    )
    return shape(summed, ["region", "hour_bin"], {"value_thousands": 5})


def q_table_scan(spark, sf):
    scan = read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"], "o_orderpriority = '1-URGENT'")
    return shape(scan, ["o_orderkey"], {"o_totalprice": 2})


def q_duplicate_keys(spark, sf):
    return shape(
        quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
        ["l_orderkey", "l_linenumber", "n_rows"],
    )


def q_group_counts(spark, sf):
    return shape(quality.group_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus", "n_rows"])


def q_dropped_for_nulls(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    dropped = quality.dropped_for_nulls(joined, ["quality", "toxic"], ["lang"])
    return shape(dropped, dropped.columns)


def q_negative_balance(spark, sf):
    return shape(quality.negative_demand(table(spark, sf, "customer"), "c_acctbal"), ["c_custkey"], {"c_acctbal": 2})


# ---- sinks --------------------------------------------------------------------------------------


def q_keyed_overwrite(spark, sf):
    """Write by key, write some keys again with other values, read back."""
    path = scratch(spark, "keyed")
    totals = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_keyed(totals, path, "o_orderpriority")
    again = totals.where(F.col("o_orderpriority") < "3").withColumn("n", -F.col("n"))
    return shape(sinks.write_keyed(again, path, "o_orderpriority", overwrite=True), ["o_orderpriority", "o_orderstatus", "n"])


def q_demand_export(spark, sf):
    """One CSV directory per priority, read back with the typed reader."""
    path = scratch(spark, "export")
    daily = table(spark, sf, "orders").groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sinks.export_by_scenario(daily, path, "o_orderpriority")
    back = spark.read.csv(path, header=True, schema="day date, n long, o_orderpriority string")
    return shape(back, ["o_orderpriority", "day", "n"])


def q_materialise(spark, sf):
    yearly = table(spark, sf, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return shape(sinks.materialise(yearly, scratch(spark, "table"), ["o_orderpriority"]), ["o_orderpriority", "y", "n"])


def _wide_sql(columns: list[str], value: str, category: str, digits: int) -> str:
    return ", ".join(
        f"round(coalesce(sum(CASE WHEN {category} = '{c}' THEN {value} END), 0), {digits}) AS {c.replace(' ', '_')}" for c in columns
    )


def _box_sql() -> str:
    return with_sql(
        "system_month hydro_month_delta",
        """SELECT Demand_or_Supply, Month, count(v) AS n, round(min(v), 4) AS minimum, round(quantile_cont(v, 0.25), 4) AS lower_quartile,
        round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS upper_quartile, round(max(v), 4) AS maximum FROM (
          SELECT s.Month, 'Demand' AS Demand_or_Supply, s.demand - s.base AS v FROM system_month s WHERE s.Year = 1998
          UNION ALL SELECT s.Month, 'Supply', h.delta FROM system_month s JOIN hydro_month_delta h ON h.Scenario = s.Scenario AND h.Month = s.Month
            AND h.period = s.ts_period WHERE s.Year = 1998) WHERE v IS NOT NULL GROUP BY 1, 2""",
    )


_SOURCES = [s for s in recode.ENERGY_SOURCES if s != "Curtailment"]
_SEASON_KEYS = "Scenario, Season, period, Hour_local, day_type, source AS gen_energy_source"

def _gen_load_delta_sql(names: str, keys: str, more: str = "") -> str:
    return with_sql(
        names,
        f"""{more}, g AS MATERIALIZED (
          SELECT Scenario, {keys}, CASE WHEN energy_category = 'zone_demand_GWh' THEN -gwh ELSE gwh END AS gwh FROM gen_load
        ), paired AS (
          SELECT *, max(CASE WHEN Scenario = '5-LOW' THEN gwh END) OVER (PARTITION BY {keys}) AS base FROM g
        )
        SELECT Scenario, {keys}, round(gwh, 5) AS Energy_GWh_typical_yr, round(base, 5) AS Energy_GWh_typical_yr_baseline,
          round(gwh - base, 5) AS Delta_AnnualGen_GWh, round((gwh - base) / base, 3) + 0.0 AS AnnualGen_perc_change_from_baseline
        FROM paired WHERE Scenario <> '5-LOW'""",
    )


QUERIES = {
    "capacity_online_zone": (
        q_capacity_online_zone,
        with_sql("cap_zone", """SELECT Scenario, PERIOD, gen_load_zone, source AS gen_energy_source, round(mw, 2) AS GenCapacityCumulative_MW,
            round(sum(mw) OVER (PARTITION BY Scenario, gen_load_zone, PERIOD), 2) AS Total_Lz_GenCap_MW FROM cap_zone"""),
    ),
    "capacity_online_wide": (
        q_capacity_online_wide,
        with_sql("cap_zone", f"SELECT Scenario, PERIOD, {_wide_sql(recode.ENERGY_SOURCES, 'mw', 'source', 2)} FROM cap_zone GROUP BY 1, 2"),
    ),
    "capacity_online_delta": (
        q_capacity_online_delta,
        with_sql("cap_delta", """SELECT Scenario, Baseline_Scenario, PERIOD, gen_load_zone, source AS gen_energy_source, round(mw, 2) AS GenCapacityCumulative_MW,
            round(base_mw, 2) AS GenCapacityCumulative_MW_baseline, round(mw - base_mw, 2) AS Delta_GenCapacity_MW, round((mw - base_mw) / base_mw, 3) + 0.0 AS GenCap_perc_change_from_baseline,
            round(total, 2) AS Total_Lz_GenCap_MW_baseline FROM cap_delta LEFT JOIN (SELECT gen_load_zone AS tz, PERIOD AS tp, sum(mw) AS total FROM cap_zone WHERE Scenario = '5-LOW' GROUP BY 1, 2)
              ON tz = gen_load_zone AND tp = PERIOD AND base_mw IS NOT NULL"""),
    ),
    "capacity_online_system_delta": (
        q_capacity_online_system_delta,
        with_sql("cap_delta", """SELECT Scenario, Baseline_Scenario, PERIOD, source AS gen_energy_source, round(sum(mw), 2) AS GenCapacityOnline_MW, round(sum(base_mw), 2) AS GenCapacityOnline_MW_baseline,
            round(sum(mw) - sum(base_mw), 2) AS Delta_GenCapacity_MW, round((sum(mw) - sum(base_mw)) / sum(base_mw), 3) + 0.0 AS GenCap_perc_change_from_baseline FROM cap_delta GROUP BY 1, 2, 3, 4"""),
    ),
    "capacity_built_delta": (
        q_capacity_built_delta,
        with_sql("build_delta", """SELECT Scenario, PERIOD, zone AS gen_load_zone, source AS gen_energy_source, round(mw, 2) AS BuildGen_MW, round(base_mw, 2) AS BuildGen_MW_baseline,
            round(mw - base_mw, 2) AS Delta_BuildGen_MW, round((mw - base_mw) / base_mw, 3) + 0.0 AS BuildGen_perc_change_from_baseline FROM build_delta"""),
    ),
    "capacity_built_cumulative": (
        q_capacity_built_cumulative,
        with_sql("build_delta", """SELECT Scenario, gen_energy_source, dense_rank() OVER (ORDER BY t, Scenario) AS scenario_rank, round(d, 2) AS CumulativeDelta_BuildGen_MW,
            round(mw, 2) AS CumulativeBuildGen_MW, round(b, 2) AS CumulativeBaselineBuildGen_MW, round(t, 2) AS TotalCumulativeDelta_BuildGen_MW FROM (
              SELECT *, sum(d) OVER (PARTITION BY Scenario) AS t FROM (SELECT Scenario, source AS gen_energy_source, sum(mw) - sum(base_mw) AS d, sum(mw) AS mw, sum(base_mw) AS b
              FROM build_delta WHERE PERIOD <> 'earlier' GROUP BY 1, 2))"""),
    ),
    "annual_loads": (
        q_annual_loads,
        with_sql("loads_year", """SELECT Scenario, load_zone, Year, ts_period, round(demand, 5) AS zone_demand_GWh, round(central, 5) AS ZoneTotalCentralDispatch_GWh,
            round(tx, 5) AS TXPowerNet_GWh, round(storage, 5) AS StorageNetCharge_GWh FROM loads_year"""),
    ),
    "annual_dispatch": (
        q_annual_dispatch,
        with_sql("dispatch_year", """SELECT Scenario, gen_load_zone, period, source AS gen_energy_source, round(gwh, 5) AS Energy_GWh_typical_yr, round(om, 5) AS VariableCost_per_yr,
            round(sum(gwh) OVER (PARTITION BY Scenario, gen_load_zone, period), 5) AS Total_annual_GWh FROM dispatch_year"""),
    ),
    "annual_dispatch_system_delta": (
        q_annual_dispatch_system_delta,
        with_sql("dispatch_year", """SELECT a.Scenario, a.period, a.source AS gen_energy_source, round(sum(a.gwh), 5) AS Energy_GWh_typical_yr, round(sum(b.gwh), 5) AS Energy_GWh_typical_yr_baseline,
            round(sum(a.gwh) - sum(b.gwh), 5) AS Delta_AnnualGen_GWh, round((sum(a.gwh) - sum(b.gwh)) / sum(b.gwh), 3) + 0.0 AS AnnualGen_perc_change_from_baseline
            FROM dispatch_year a LEFT JOIN dispatch_year b ON b.Scenario = '5-LOW' AND a.period = b.period AND a.gen_load_zone = b.gen_load_zone AND a.source = b.source
            WHERE a.Scenario <> '5-LOW' GROUP BY 1, 2, 3"""),
    ),
    "gen_load_wide": (
        q_gen_load_wide,
        with_sql("gen_load", f"SELECT Scenario, ts_period, {_wide_sql(recode.ENERGY_SOURCES + co.LOAD_CATEGORIES, 'gwh', 'energy_category', 5)} FROM gen_load GROUP BY 1, 2"),
    ),
    "gen_load_delta": (q_gen_load_delta, _gen_load_delta_sql("gen_load", "ts_period, energy_category")),
    "gen_load_zone_delta": (
        q_gen_load_zone_delta,
        _gen_load_delta_sql(
            "dispatch_year loads_year",
            "load_zone, ts_period, energy_category",
            """, gen_load AS (SELECT Scenario, gen_load_zone AS load_zone, period AS ts_period, source AS energy_category, gwh FROM dispatch_year
            UNION ALL SELECT Scenario, load_zone, ts_period, 'zone_demand_GWh', demand FROM loads_year
            UNION ALL SELECT Scenario, load_zone, ts_period, 'ZoneTotalCentralDispatch_GWh', central FROM loads_year
            UNION ALL SELECT Scenario, load_zone, ts_period, 'TXPowerNet_GWh', tx FROM loads_year
            UNION ALL SELECT Scenario, load_zone, ts_period, 'StorageNetCharge_GWh', storage FROM loads_year)""",
        ),
    ),
    "load_hydro_disaggregation": (
        q_load_hydro_disaggregation,
        _disagg_sql("zone", """SELECT Scenario, y AS ts_period, load_zone, cause AS energy_category_disagg, family AS climate_impacts_included, round(d, 5) AS Delta_AnnualGen_GWh,
            round(d / base, 3) + 0.0 AS AnnualGen_perc_change_from_baseline FROM parts"""),
    ),
    "imbalance_ranking": (
        q_imbalance_ranking,
        _disagg_sql("", """SELECT Scenario, y AS ts_period, cause AS energy_category_disagg, dense_rank() OVER (ORDER BY t, Scenario) AS scenario_rank, round(adj, 5) AS Adj_Delta_AnnualGen_GWh,
            round(t, 5) AS TotalImbalance_GWh FROM (SELECT *, sum(adj) OVER (PARTITION BY y, Scenario) AS t FROM (SELECT *, CASE WHEN cause = 'Water' THEN -d ELSE d END AS adj FROM parts WHERE y = 1998))"""),
    ),
    "load_delta_zone": (q_load_delta_zone, _load_delta_sql("Scenario, load_zone, Year, ts_period", "true", "", "")),
    "load_delta_system": (q_load_delta_system, _load_delta_sql("Scenario, Year, ts_period", "true", "", "")),
    "load_delta_us": (q_load_delta_us, _load_delta_sql("Scenario, Year, ts_period", "load_zone NOT IN ('CAN_ALB', 'CAN_BC', 'MEX_BAJA')", "", "")),
    "cost_items_delta": (
        q_cost_items_delta,
        with_sql("cost_delta", """SELECT Scenario, PERIOD, Component, round(npv, 2) AS PeriodCost_NPV, round(real, 2) AS PeriodCost_Real, round(npv - npv_b, 2) AS Delta_PeriodCost_NPV,
            round(real - real_b, 2) AS Delta_PeriodCost_Real, round((npv - npv_b) / npv_b, 3) + 0.0 AS PeriodCost_NPV_perc_change_from_baseline FROM cost_delta"""),
    ),
    "cost_period_delta": (
        q_cost_period_delta,
        with_sql("cost_delta", """SELECT Scenario, PERIOD, round(sum(npv), 2) AS PeriodCost_NPV, round(sum(real), 2) AS PeriodCost_Real, round(sum(npv - npv_b), 2) AS Delta_PeriodCost_NPV,
            round(sum(real - real_b), 2) AS Delta_PeriodCost_Real FROM cost_delta GROUP BY 1, 2"""),
    ),
    "cost_total_delta": (
        q_cost_total_delta,
        with_sql("cost_delta", """SELECT Scenario, '5-LOW' AS Baseline_Scenario, round(sum(npv), 2) AS PeriodCost_NPV, round(sum(npv - npv_b), 2) AS Delta_PeriodCost_NPV,
            round(sum(real - real_b), 2) AS Delta_PeriodCost_Real, round(sum(npv - npv_b) / sum(npv_b), 8) AS TotalCost_NPV_perc_change_from_baseline,
            round(sum(real - real_b) / sum(real_b), 8) AS TotalCost_Real_perc_change_from_baseline FROM cost_delta GROUP BY 1"""),
    ),
    "monthly_load_delta": (
        q_monthly_load_delta,
        with_sql("month_delta", """SELECT Scenario, load_zone, Month, Year, ts_period, round(demand, 3) AS zone_demand_mw, round(demand_b, 3) AS zone_demand_mw_baseline,
            round(demand_b - demand, 3) + 0.0 AS Delta_zone_demand_mw, round((demand_b - demand) / demand_b, 3) + 0.0 AS zone_demand_mw_perc_change_from_baseline,
            round(central_b - central, 3) AS Delta_ZoneTotalCentralDispatch FROM month_delta"""),
    ),
    "monthly_system_load_delta": (
        q_monthly_system_load_delta,
        with_sql("system_month", """SELECT Scenario, Month, Year, ts_period, round(demand, 3) AS zone_demand_mw, round(base, 3) AS zone_demand_mw_baseline,
            round(demand - base, 3) + 0.0 AS Delta_zone_demand_mw, round((demand - base) / base, 7) + 0.0 AS Delta_perc_zone_demand_mw FROM system_month"""),
    ),
    "monthly_us_load_delta": (
        q_monthly_us_load_delta,
        with_sql("month_delta", """, us AS (SELECT Scenario, Month, Year, ts_period, CASE WHEN count(demand_b) = count(*) THEN -sum(demand_b) END AS base,
              -sum(demand) AS demand FROM month_delta WHERE load_zone NOT IN ('CAN_ALB', 'CAN_BC', 'MEX_BAJA') GROUP BY 1, 2, 3, 4)
            SELECT Scenario, Month, Year, ts_period, round(demand, 3) AS zone_demand_mw, round(base, 3) AS zone_demand_mw_baseline,
            round(demand - base, 3) + 0.0 AS Delta_zone_demand_mw, round((demand - base) / base, 7) + 0.0 AS Delta_perc_zone_demand_mw FROM us"""),
    ),
    "focus_dispatch": (
        q_focus_dispatch,
        with_sql("season_delta", """, c AS MATERIALIZED (SELECT * FROM season_delta WHERE Scenario = '1-URGENT' AND day_type = 'peak_day' AND period = 1998 AND base IS NOT NULL)
            SELECT '1-URGENT' AS Scenario, e.Season, 1998 AS period, h.Hour_local, 'peak_day' AS day_type, o.source AS gen_energy_source,
            round(coalesce(c.mw, 0), 5) AS DispatchGen_MW, round(coalesce(c.base, 0), 5) AS DispatchGen_MW_baseline, round(coalesce(c.mw - c.base, 0), 5) + 0.0 AS Delta_DispatchGen_MW
            FROM (SELECT DISTINCT Season FROM c) e, (SELECT DISTINCT Hour_local FROM c) h, (SELECT DISTINCT source FROM c) o
            LEFT JOIN c ON c.Season = e.Season AND c.Hour_local = h.Hour_local AND c.source = o.source"""),
    ),
    "pivot_nulls": (
        q_pivot_nulls,
        """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F,
        round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS P
        FROM orders GROUP BY 1, 2""",
    ),
    "tx_edges_long": (
        q_tx_edges_long,
        with_sql("tx", """SELECT Scenario, line AS TRANSMISSION_LINE, PERIOD, a.n_name AS LOAD_ZONE1, b.n_name AS LOAD_ZONE2, t.Tx_type,
            round(CASE t.k WHEN 0 THEN nameplate ELSE existing END / 1000, 8) AS Tx_GW FROM tx JOIN nation a ON a.n_nationkey = CAST(lz1 AS INTEGER)
            JOIN nation b ON b.n_nationkey = CAST(lz2 AS INTEGER),
            (VALUES (0, 'Total Tx Nameplate Capacity'), (1, 'Existing Tx Capacity')) AS t(k, Tx_type)"""),
    ),
    "duration_curve": (
        q_duration_curve,
        with_sql("balance points series", """SELECT Scenario, ts_period, timestamp, row_number() OVER (PARTITION BY Scenario, ts_period ORDER BY abs(demand) DESC, timestamp) AS counter,
            round(demand, 2) AS zone_demand_mw FROM (SELECT b.Scenario, s.ts_period, b.stamp AS timestamp, sum(demand) AS demand FROM balance b JOIN points p ON b.stamp = p.timestamp
            JOIN series s ON p.timeseries = s.timeseries GROUP BY 1, 2, 3)"""),
    ),
    "order_value_curve": (
        q_order_value_curve,
        """SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(o_totalprice) DESC, o_orderkey) AS counter,
            o_totalprice FROM orders""",
    ),
    "hourly_dispatch": (
        q_hourly_dispatch,
        with_sql("hour_system", """SELECT Scenario, source AS gen_energy_source, period, Month, CAST(substr(stamp, 9, 2) AS BIGINT) AS Hour_UTC, Hour_local, day_type,
            CASE WHEN Month IN (3, 4, 5) THEN 'Spring' WHEN Month IN (6, 7, 8) THEN 'Summer' WHEN Month IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS Season,
            round(sum(mw), 2) AS DispatchGen_MW, round(sum(curt), 2) AS Curtailment_MW FROM hour_system GROUP BY 1, 2, 3, 4, 5, 6, 7"""),
    ),
    "seasonal_dispatch": (q_seasonal_dispatch, with_sql("seasonal", f"SELECT {_SEASON_KEYS}, round(mw, 5) AS DispatchGen_MW FROM seasonal")),
    "seasonal_dispatch_delta": (
        q_seasonal_dispatch_delta,
        with_sql("season_delta", f"""SELECT {_SEASON_KEYS}, round(mw, 5) AS DispatchGen_MW, round(mw - base, 5) + 0.0 AS Delta_DispatchGen_MW,
            round((mw - base) / base, 3) + 0.0 AS DispatchGen_perc_change_from_baseline FROM season_delta"""),
    ),
    "seasonal_dispatch_dense": (
        q_seasonal_dispatch_dense,
        with_sql("season_delta", """SELECT s.Scenario, e.Season, p.period, h.Hour_local, t.day_type, o.source AS gen_energy_source, round(coalesce(d.mw, 0), 5) AS DispatchGen_MW,
            round(coalesce(d.mw - d.base, 0), 5) + 0.0 AS Delta_DispatchGen_MW FROM (SELECT DISTINCT Scenario FROM season_delta) s, (SELECT DISTINCT Season FROM season_delta) e,
            (SELECT DISTINCT period FROM season_delta) p, (SELECT DISTINCT Hour_local FROM season_delta) h, (SELECT DISTINCT day_type FROM season_delta) t,
            (SELECT DISTINCT source FROM season_delta) o LEFT JOIN season_delta d ON d.Scenario = s.Scenario AND d.Season = e.Season AND d.period = p.period
              AND d.Hour_local = h.Hour_local AND d.day_type = t.day_type AND d.source = o.source"""),
    ),
    "hydro_monthly_delta": (
        q_hydro_monthly_delta,
        with_sql("hydro_month_delta", """SELECT Scenario, period, Month, round(mwh, 2) AS Monthly_DispatchGen_MW, round(base, 2) AS Monthly_DispatchGen_MW_baseline, round(delta, 2) AS Delta_Monthly_DispatchGen_MW,
            round(delta / base, 8) AS PercDelta_Monthly_DispatchGen_MW FROM hydro_month_delta"""),
    ),
    "monthly_load_hydro_box": (q_monthly_load_hydro_box, _box_sql()),
    "tx_lines": (
        q_tx_lines,
        with_sql("tx", """SELECT Scenario, line AS TRANSMISSION_LINE, PERIOD, built AS BuildTx,
            sum(built) OVER (PARTITION BY Scenario, line, lz1, lz2 ORDER BY PERIOD) AS cumulative_BuiltTx_MW FROM tx"""),
    ),
    "tx_report": (q_tx_report, with_sql("tx_types", "SELECT Scenario, PERIOD, Tx_type, round(mw, 3) AS MW_Tx FROM tx_types")),
    "tx_delta": (
        q_tx_delta,
        with_sql("tx_types", """SELECT a.Scenario, b.Scenario AS Baseline_Scenario, a.PERIOD, a.Tx_type, round(a.mw, 3) AS MW_Tx, round(b.mw, 3) AS MW_Tx_baseline,
            round(a.mw - b.mw, 3) AS Delta_MW_Tx, round((a.mw - b.mw) / b.mw, 3) + 0.0 AS Tx_perc_change_from_baseline FROM tx_types a LEFT JOIN tx_types b
            ON b.Scenario = '5-LOW' AND a.PERIOD = b.PERIOD AND a.Tx_type = b.Tx_type WHERE a.Scenario <> '5-LOW'"""),
    ),
    "tx_edges": (
        q_tx_edges,
        with_sql("tx", """SELECT Scenario, line AS TRANSMISSION_LINE, PERIOD, CAST(lz1 AS BIGINT) AS zone_id1, CAST(lz2 AS BIGINT) AS zone_id2, a.n_name AS LOAD_ZONE1, b.n_name AS LOAD_ZONE2,
            round(p.x, 4) AS X1, p.y AS Y1, round(q.x, 4) AS X2, q.y AS Y2, round(nameplate / 1000, 8) AS nameplate_GW, round(built / 1000, 8) AS BuildTx_GW,
            round(sum(built / 1000) OVER (PARTITION BY Scenario, line), 8) AS total_new_BuildTx_GW FROM tx JOIN nation a ON a.n_nationkey = CAST(lz1 AS INTEGER)
            JOIN nation b ON b.n_nationkey = CAST(lz2 AS INTEGER)
            JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS x, count(*) AS y FROM customer GROUP BY 1) p ON p.k = a.n_nationkey
            JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS x, count(*) AS y FROM customer GROUP BY 1) q ON q.k = b.n_nationkey"""),
    ),
    "zone_map_table": (
        q_zone_map_table,
        with_sql("cap_delta", f"""SELECT s.Scenario, z.gen_load_zone, o.source AS gen_energy_source, p.PERIOD, c.X, c.Y, round(d.mw - d.base_mw, 2) AS Delta_GenCapacity_MW
            FROM (SELECT DISTINCT Scenario FROM cap_delta) s, (SELECT DISTINCT gen_load_zone FROM cap_delta) z, (SELECT DISTINCT source FROM cap_delta) o,
            (SELECT unnest(range(1995, 2003)) AS PERIOD) p LEFT JOIN cap_delta d ON d.Scenario = s.Scenario AND d.gen_load_zone = z.gen_load_zone AND d.source = o.source AND d.PERIOD = p.PERIOD
            LEFT JOIN (SELECT {i.sql_choose("n_regionkey", i.ZONES)} AS zone, count(*) AS X, count(DISTINCT s_nationkey) AS Y FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) c
              ON c.zone = z.gen_load_zone"""),
    ),
    "zone_source_mix": (
        q_zone_source_mix,
        with_sql("cap_delta", f"""SELECT PERIOD, gen_load_zone, X, Y, {_wide_sql(_SOURCES, 'base_mw', 'source', 2)}, round(sqrt(max(total) / pi()), 6) AS radius FROM cap_delta LEFT JOIN (SELECT gen_load_zone AS tz, PERIOD AS tp, sum(mw) AS total FROM cap_zone WHERE Scenario = '5-LOW' GROUP BY 1, 2)
              ON tz = gen_load_zone AND tp = PERIOD AND base_mw IS NOT NULL
            JOIN (SELECT {i.sql_choose("n_regionkey", i.ZONES)} AS zone, count(*) AS X, count(DISTINCT s_nationkey) AS Y FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
            ON zone = gen_load_zone WHERE Scenario = '1-URGENT' AND PERIOD = 1998 GROUP BY 1, 2, 3, 4"""),
    ),
    "catchment_climate": (
        q_catchment_climate,
        with_sql("catch_avg", """SELECT Scenario, num AS Catchment_num, name AS Catchment_name, region AS Region, y AS Year, m AS Month, round(tavg, 6) AS tavg_C, round(km3, 9) AS Precip_km3,
            round(avg_t, 6) AS avg_tavg_C, round(avg_km3, 9) AS avg_Precip_km3, CAST(km2 AS DOUBLE) AS total_catchment_area_km2 FROM catch_avg"""),
    ),
    "climate_delta_by_region": (
        q_climate_delta_by_region,
        with_sql("hist_year cc_year", """SELECT Scenario, y AS Year, c.region AS Region, round(avg(c.t - h.t), 6) AS delta_annual_avg_tavg_C, round(sum(c.k - h.k), 8) AS delta_annual_total_Precip_km3,
            round(avg(c.t), 6) AS annual_avg_tavg_C, round(avg(h.t), 6) AS annual_hist_avg_tavg_C, round(sum(c.k), 8) AS annual_total_Precip_km3,
            round(sum(h.k), 8) AS annual_hist_avg_Precip_km3, CAST(sum(c.km2) AS DOUBLE) AS total_region_area_km2
            FROM cc_year c JOIN hist_year h ON c.num = h.num AND c.km2 = h.km2 GROUP BY 1, 2, 3"""),
    ),
    "climate_vs_energy_fit": (
        q_climate_vs_energy_fit,
        with_sql("hist_year cc_year results", "@").replace(" @", """, clim AS (SELECT Scenario, c.region, avg(c.t - h.t) AS t, sum(c.k - h.k) AS k
              FROM cc_year c JOIN hist_year h ON c.num = h.num AND c.km2 = h.km2 WHERE y = 1998 GROUP BY 1, 2),
            e AS (SELECT c_mktsegment AS s, gen_load_zone AS z, source, sum(l_extendedprice) / 1000 AS g FROM results JOIN customer ON o_custkey = c_custkey WHERE y = 1998 GROUP BY 1, 2, 3),
            d AS (SELECT a.s, a.source, CASE a.z WHEN 'CAN_BC' THEN 'CAN' WHEN 'CA_SCE' THEN 'SW' WHEN 'WA_E' THEN 'PacNW' ELSE 'MT' END AS region, sum(a.g - b.g) AS g
              FROM e a JOIN e b ON b.s = 'BUILDING' AND a.z = b.z AND a.source = b.source WHERE a.s <> 'BUILDING' GROUP BY 1, 2, 3)
            SELECT CASE source WHEN 'Water' THEN 'Hydropower' ELSE source END AS energy_category_disagg, d.region AS Region, round(regr_r2(g, t), 6) AS temp_r2,
              round(regr_slope(g, t), 4) AS temp_slope, round(regr_r2(g, k), 6) AS precip_r2 FROM d JOIN clim c ON c.Scenario = d.s AND c.region = d.region GROUP BY 1, 2"""),
    ),
    "scenario_delta_plain": (_delta_query("plain"), _delta_sql("a.v - b.v", "(a.v - b.v) / b.v")),
    "scenario_delta_abs": (
        _delta_query("abs"),
        _delta_sql("abs(a.v) - abs(b.v)", "(abs(a.v) - abs(b.v)) / abs(b.v)", "-sum(o_totalprice)"),
    ),
    "scenario_delta_reversed": (_delta_query("reversed"), _delta_sql("b.v - a.v", "(b.v - a.v) / b.v")),
    "scenario_delta_full": (
        q_scenario_delta_full,
        """WITH s AS (SELECT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1, 2), o AS (SELECT * FROM s WHERE p <> '5-LOW'), b AS (SELECT * FROM s WHERE p = '5-LOW'),
        g AS (SELECT p, d FROM o UNION SELECT x.p, b.d FROM (SELECT DISTINCT p FROM o) x, b)
        SELECT g.p AS Scenario, count(*) AS rows, count(o.d) AS with_scenario, count(b.d) AS with_baseline, count(CASE WHEN o.d IS NOT NULL AND b.d IS NOT NULL THEN 1 END) AS with_both
        FROM g LEFT JOIN o ON g.p = o.p AND g.d = o.d LEFT JOIN b ON g.d = b.d GROUP BY 1""",
    ),
    "rollup_delta": (
        q_rollup_delta,
        """WITH s AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
        SELECT a.p AS Scenario, b.p AS Baseline_Scenario, a.y, round(a.v, 2) AS price, round(b.v, 2) AS price_baseline, round(a.v - b.v, 2) AS delta_price,
        round((a.v - b.v) / b.v, 3) + 0.0 AS price_perc_change_from_baseline FROM s a JOIN s b ON b.p = '5-LOW' AND a.y = b.y WHERE a.p <> '5-LOW'""",
    ),
    "drop_undefined_change": (
        q_drop_undefined_change,
        """WITH s AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, month(o_orderdate) AS m, sum(CASE WHEN o_totalprice < 3500 THEN 1.0 ELSE 0.0 END)::DOUBLE AS n FROM orders GROUP BY 1, 2, 3)
        SELECT a.p AS Scenario, a.y, a.m, CASE WHEN b.n = 0 THEN 'infinite' ELSE 'finite' END AS kind, a.n - b.n AS delta_n FROM s a JOIN s b ON b.p = '5-LOW' AND a.y = b.y AND a.m = b.m
        WHERE a.p <> '5-LOW' AND NOT (a.n = 0 AND b.n = 0)""",
    ),
    "running_total": (
        q_running_total,
        """WITH s AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
        SELECT o_orderpriority, strftime(d, '%Y-%m-%d') AS day, round(v, 2) AS price, round(sum(v) OVER (PARTITION BY o_orderpriority ORDER BY d), 2) AS running_price FROM s""",
    ),
    "group_fit": (
        q_group_fit,
        """SELECT l_returnflag, l_linestatus, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
        round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1, 2""",
    ),
    "five_number": (
        q_five_number,
        """SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS minimum, round(quantile_cont(l_extendedprice, 0.25), 4) AS lower_quartile,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS upper_quartile, round(max(l_extendedprice), 4) AS maximum FROM lineitem GROUP BY 1""",
    ),
    "mixed_rollup": (
        q_mixed_rollup,
        """SELECT n_regionkey, n_name, round(avg(c_acctbal), 5) AS mean_balance, CAST(sum(c_custkey) AS BIGINT) AS sum_keys FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    ),
    "distinct_counts": (
        q_distinct_counts,
        "SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1",
    ),
    "category_rank": (
        q_category_rank,
        "SELECT o_orderpriority, row_number() OVER (ORDER BY sum(o_totalprice), o_orderpriority) AS category_rank, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    ),
    "partition_total": (
        q_partition_total,
        """SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS price, round(sum(sum(o_totalprice)) OVER (PARTITION BY o_orderpriority), 2) AS priority_price
        FROM orders GROUP BY 1, 2""",
    ),
    "to_long": (
        q_to_long,
        """SELECT o_orderpriority, 'lowest' AS statistic, min(o_totalprice) AS price FROM orders GROUP BY 1 UNION ALL
        SELECT o_orderpriority, 'highest', max(o_totalprice) FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, 'mean', round(avg(o_totalprice), 4) FROM orders GROUP BY 1""",
    ),
    "pivot_fill": (
        q_pivot_fill,
        """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS F,
        round(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 0), 2) AS O, round(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0), 2) AS P
        FROM orders GROUP BY 1, 2""",
    ),
    "densify": (
        q_densify,
        """WITH s AS (SELECT o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
        SELECT a.o_orderpriority, b.o_orderstatus, strftime(c.d, '%Y-%m-%d') AS day, round(coalesce(v, 0), 2) AS price FROM (SELECT DISTINCT o_orderpriority FROM s) a, (SELECT DISTINCT o_orderstatus FROM s) b,
        (SELECT DISTINCT d FROM s) c LEFT JOIN s ON s.o_orderpriority = a.o_orderpriority AND s.o_orderstatus = b.o_orderstatus AND s.d = c.d""",
    ),
    "recode_sources": (
        q_recode_sources,
        with_sql("results", """SELECT source, tech_group, CASE tech_group WHEN 'Coal' THEN 1 WHEN 'Thermal' THEN 2 WHEN 'Hydro' THEN 6 WHEN 'Wind' THEN 8 WHEN 'Solar' THEN 10 ELSE 11 END AS group_rank,
            sum(l_quantity) AS quantity FROM (SELECT *, CASE gen_tech WHEN 'Battery_Storage' THEN 'Storage' WHEN 'CCGT' THEN 'Thermal' WHEN 'Hydro_NonPumped' THEN 'Hydro'
            WHEN 'Central_PV' THEN 'Solar' WHEN 'Wind' THEN 'Wind' ELSE 'Coal' END AS tech_group FROM results) GROUP BY 1, 2, 3"""),
    ),
    "period_bins": (
        q_period_bins,
        """SELECT CASE WHEN year(o_orderdate) < 1998 THEN '1996' WHEN year(o_orderdate) < 2001 THEN '1999' ELSE 'later' END AS period,
        CASE WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' WHEN month(o_orderdate) IN (9, 10, 11) THEN 'Fall' ELSE 'Winter' END AS season,
        count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2""",
    ),
    "regions_and_hours": (
        q_regions_and_hours,
        """SELECT CASE event_type WHEN 'click' THEN 'SW' WHEN 'error' THEN 'PacNW' ELSE 'MT' END AS region, CAST((hour(ts) // 4 + 1) * 4 AS BIGINT) AS hour_bin,
        round(sum(value / 1000), 5) AS value_thousands FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1, 2""",
    ),
    "table_scan": (q_table_scan, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "duplicate_keys": (
        q_duplicate_keys,
        "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    ),
    "group_counts": (q_group_counts, "SELECT l_returnflag, l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY 1, 2"),
    "dropped_for_nulls": (
        q_dropped_for_nulls,
        """SELECT lang, count(*) AS rows_before, count(quality) AS rows_after, count(*) - count(quality) AS rows_dropped FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    ),
    "negative_balance": (q_negative_balance, "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0"),
    "keyed_overwrite": (
        q_keyed_overwrite,
        """SELECT o_orderpriority, o_orderstatus, CASE WHEN o_orderpriority < '3' THEN -count(*) ELSE count(*) END AS n FROM orders GROUP BY 1, 2""",
    ),
    "demand_export": (
        q_demand_export,
        "SELECT o_orderpriority, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "materialise": (q_materialise, "SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2"),
}
