"""Scenario results against the baseline: capacity, dispatch, loads, costs, transmission.

The scenario (and where needed the impact family) is an ordinary key, so every report covers all
runs in one job. Reports are dictionaries of lazy DataFrames.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import day_type_of, local_hour, season_of, with_compact_parts
from ..functions.missing import na_mean, na_sum, number_or_zero, r_div, zero_unless
from ..functions.recode import (
    ENERGY_SOURCES,
    PERIOD_LABELS,
    TX_TYPES,
    bin_period,
    is_us_zone,
    normalise_source,
    relabel,
)
from ..functions.units import thousandth
from ..operators.delta import add_differences, drop_undefined_change, rollup_delta, scenario_delta
from ..operators.grouped import five_number, rank_by_total
from ..operators.matching import densify, match, with_total
from ..operators.ordered import duration_curve, running_total
from ..operators.reshape import pivot_fill, to_long
from ..quality import complete_rows
from ..sources.parameters import BASELINE, COMBINED_FAMILY, COOLING_FAMILY, WATER_FAMILY
from .water_load import annualise

ENERGY_COLUMN = "Energy_GWh_typical_yr"
LOAD_MEASURES = ["zone_demand_mw", "ZoneTotalCentralDispatch", "TXPowerNet", "StorageNetCharge"]
LOAD_CATEGORIES = ["zone_demand_GWh", "ZoneTotalCentralDispatch_GWh", "TXPowerNet_GWh", "StorageNetCharge_GWh"]
CAPACITY = {"GenCapacityCumulative_MW": ("Delta_GenCapacity_MW", "GenCap_perc_change_from_baseline")}
CAPACITY_ONLINE = {"GenCapacityOnline_MW": ("Delta_GenCapacity_MW", "GenCap_perc_change_from_baseline")}
BUILD = {"BuildGen_MW": ("Delta_BuildGen_MW", "BuildGen_perc_change_from_baseline")}
ENERGY = {"Energy_GWh_typical_yr": ("Delta_AnnualGen_GWh", "AnnualGen_perc_change_from_baseline")}
LOADS = {
    "zone_demand_GWh": ("Delta_zone_demand_GWh", "AnnualLoad_perc_change_from_baseline"),
    "ZoneTotalCentralDispatch_GWh": (
        "Delta_ZoneTotalCentralDispatch_GWh",
        "AnnualCentralDispatch_perc_change_from_baseline",
    ),
    "StorageNetCharge_GWh": ("Delta_StorageNetCharge_GWh", "AnnualStorageNetCharge_perc_change_from_baseline"),
    "TXPowerNet_GWh": ("Delta_TXPowerNet_GWh", "AnnualTxPowerNet_perc_change_from_baseline"),
}
COSTS = {
    "PeriodCost_NPV": ("Delta_PeriodCost_NPV", "PeriodCost_NPV_perc_change_from_baseline"),
    "PeriodCost_Real": ("Delta_PeriodCost_Real", "PeriodCost_Real_perc_change_from_baseline"),
}


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("gen_energy_source", normalise_source("gen_energy_source", "gen_tech"))


def _by_zone_and_source(df: DataFrame, time: str, measure: str, name: str, total: str) -> DataFrame:
    """Sum by zone, time and source, with the zone's total over all sources."""
    keys = ["Scenario", "gen_load_zone", time]
    summed = with_source(df).groupBy(*keys, "gen_energy_source").agg(na_sum(measure).alias(name))
    return with_total(summed, name, keys, total, few_rows=True)


def capacity_online(gen_cap: DataFrame, baseline: str = BASELINE) -> dict[str, DataFrame]:
    """Online capacity by zone, source and period; system totals; wide table; deltas."""
    complete = complete_rows(gen_cap)
    zone = _by_zone_and_source(complete, "PERIOD", "GenCapacity", "GenCapacityCumulative_MW", "Total_Lz_GenCap_MW")
    system = zone.groupBy("Scenario", "PERIOD", "gen_energy_source").agg(
        na_sum("GenCapacityCumulative_MW").alias("GenCapacityOnline_MW")
    )
    keys = ["PERIOD", "gen_load_zone", "gen_energy_source"]
    zone_delta = scenario_delta(zone, baseline, keys, CAPACITY)
    renamed = zone_delta.withColumnsRenamed(
        {
            "GenCapacityCumulative_MW": "GenCapacityOnline_MW",
            "GenCapacityCumulative_MW_baseline": "GenCapacityOnline_MW_baseline",
        }
    )
    return {
        "zone": zone,
        "system": system,
        "system_wide": pivot_fill(
            system, ["Scenario", "PERIOD"], "gen_energy_source", "GenCapacityOnline_MW", ENERGY_SOURCES
        ),
        "zone_delta": zone_delta,
        "system_delta": rollup_delta(
            renamed, ["Scenario", "Baseline_Scenario", "PERIOD", "gen_energy_source"], CAPACITY_ONLINE
        ),
    }


def capacity_built(
    builds: DataFrame, projects: DataFrame, baseline: str = BASELINE, periods=None, before: str = "pre-2030"
) -> dict[str, DataFrame]:
    """Capacity built by zone, source and period; deltas; cumulative builds and scenario order.

    Build years are summed to periods before the comparison, so that the delta matches one row per
    zone, source and period.
    """
    renamed = builds.withColumnsRenamed({"GEN_BLD_YRS_1": "GENERATION_PROJECT", "GEN_BLD_YRS_2": "YEAR"})
    keys = ["GENERATION_PROJECT"] + (["Scenario"] if "Scenario" in projects.columns else [])
    joined = match(renamed, projects.select(*keys, "gen_tech", "gen_energy_source", "gen_load_zone"), keys)
    yearly = _by_zone_and_source(joined, "YEAR", "BuildGen", "BuildGen_MW", "Total_BuildGen_MW")
    labelled = yearly.withColumn("PERIOD", bin_period("YEAR", periods, before))
    zone = labelled.groupBy("Scenario", "gen_load_zone", "PERIOD", "gen_energy_source").agg(
        na_sum("BuildGen_MW").alias("BuildGen_MW")
    )
    system = zone.groupBy("Scenario", "PERIOD", "gen_energy_source").agg(na_sum("BuildGen_MW").alias("BuildGen_MW"))
    zone_delta = scenario_delta(zone, baseline, ["PERIOD", "gen_load_zone", "gen_energy_source"], BUILD)
    keys = ["Scenario", "Baseline_Scenario"]
    system_delta = rollup_delta(zone_delta, [*keys, "PERIOD", "gen_energy_source"], BUILD)
    cumulative = (
        system_delta.where(F.col("PERIOD") != before)
        .groupBy(*keys, "gen_energy_source")
        .agg(
            na_sum("Delta_BuildGen_MW").alias("CumulativeDelta_BuildGen_MW"),
            na_sum("BuildGen_MW").alias("CumulativeBuildGen_MW"),
            na_sum("BuildGen_MW_baseline").alias("CumulativeBaselineBuildGen_MW"),
        )
    )
    total = "TotalCumulativeDelta_BuildGen_MW"
    totals = with_total(cumulative, "CumulativeDelta_BuildGen_MW", keys, total, few_rows=True)
    ranked = rank_by_total(totals, "Scenario", total, "scenario_rank")
    return {
        "zone_year": labelled,
        "zone": zone,
        "system": system,
        "system_wide": pivot_fill(
            system, ["Scenario", "PERIOD"], "gen_energy_source", "BuildGen_MW", ENERGY_SOURCES
        ),
        "zone_delta": zone_delta,
        "system_delta": system_delta,
        "cumulative": ranked,
        "scenario_order": ranked.select("Scenario", "scenario_rank").distinct(),
    }


def annual_loads(
    load_balance: DataFrame, timepoints: DataFrame, timeseries: DataFrame, period_years: int = 5
) -> dict[str, DataFrame]:
    """Sampled load balance scaled to GWh per year by zone, and for the system."""
    keys = [c for c in ("Scenario",) if c in timepoints.columns and c in timeseries.columns]
    points = match(timepoints, timeseries, {"timeseries": "TIMESERIES", **{k: k for k in keys}})
    points = points.drop("timeseries", "timepoint_id")
    names = dict(zip(LOAD_MEASURES, LOAD_CATEGORIES))
    zone = annualise(
        with_compact_parts(load_balance),
        points,
        ["timestamp", *keys],
        LOAD_MEASURES,
        ["load_zone", "Year", "ts_period", "Scenario"],
        period_years,
        to_gwh=True,
        names=names,
    )
    system = zone.groupBy("Year", "ts_period", "Scenario").agg(*[na_sum(c).alias(c) for c in LOAD_CATEGORIES])
    return {"zone": zone, "system": system}


def annual_dispatch(
    dispatch: DataFrame, loads: dict[str, DataFrame], baseline: str = BASELINE
) -> dict[str, DataFrame]:
    """Annual energy by zone and source, combined with loads; wide tables; deltas."""
    keys = ["Scenario", "gen_load_zone", "period"]
    summed = (
        with_source(dispatch)
        .groupBy(*keys, "gen_energy_source")
        .agg(
            na_sum("Energy_GWh_typical_yr").alias("Energy_GWh_typical_yr"),
            na_sum("VariableOMCost_per_yr").alias("VariableCost_per_yr"),
        )
    )
    zone = with_total(summed, "Energy_GWh_typical_yr", keys, "Total_annual_GWh", few_rows=True)
    system = zone.groupBy("Scenario", "period", "gen_energy_source").agg(
        na_sum("Energy_GWh_typical_yr").alias("Energy_GWh_typical_yr")
    )
    zone_delta = scenario_delta(zone, baseline, ["period", "gen_load_zone", "gen_energy_source"], ENERGY)
    system_delta = drop_undefined_change(
        rollup_delta(zone_delta, ["Scenario", "Baseline_Scenario", "period", "gen_energy_source"], ENERGY),
        "AnnualGen_perc_change_from_baseline",
    )

    def with_loads(generation: DataFrame, load: DataFrame, zones: list[str]) -> DataFrame:
        ids = [*zones, "Scenario", "ts_period"]
        source = generation.withColumnsRenamed(
            {"gen_energy_source": "energy_category", "period": "ts_period", "gen_load_zone": "load_zone"}
        )
        long = to_long(load.select(*ids, *LOAD_CATEGORIES), ids, LOAD_CATEGORIES, "energy_category", ENERGY_COLUMN)
        return source.select(*ids, "energy_category", ENERGY_COLUMN).unionByName(long)

    combined = with_loads(system, loads["system"], [])
    combined_zone = with_loads(zone, loads["zone"], ["load_zone"])
    return {
        "zone": zone,
        "system": system,
        "system_wide": pivot_fill(
            system, ["Scenario", "period"], "gen_energy_source", "Energy_GWh_typical_yr", ENERGY_SOURCES
        ),
        "zone_delta": zone_delta,
        "system_delta": system_delta,
        "gen_load": combined,
        "gen_load_wide": pivot_fill(
            combined, ["Scenario", "ts_period"], "energy_category", ENERGY_COLUMN, ENERGY_SOURCES + LOAD_CATEGORIES
        ),
        "gen_load_delta": demand_positive_delta(combined, ["ts_period", "energy_category"], baseline),
        "gen_load_zone_delta": demand_positive_delta(
            combined_zone, ["ts_period", "energy_category", "load_zone"], baseline
        ),
    }


def demand_positive_delta(combined: DataFrame, keys: list[str], baseline: str = BASELINE) -> DataFrame:
    """Deltas of generation and load, with demand counted as positive."""
    value = F.col(ENERGY_COLUMN)
    positive = combined.withColumn(
        ENERGY_COLUMN, F.when(F.col("energy_category") == "zone_demand_GWh", -value).otherwise(value)
    )
    return scenario_delta(positive, baseline, keys, ENERGY)


def load_hydro_disaggregation(deltas: DataFrame) -> DataFrame:
    """Load and hydropower changes by cause.

    ``deltas`` stacks the delta tables of the three impact families (``climate_impacts_included``).
    Water comes from the combined runs; the water-only and the cooling-only runs give the two parts of
    the load change; the combined load change is left out.
    """
    family, category = F.col("climate_impacts_included"), F.col("energy_category")
    load = category == "zone_demand_GWh"
    cause = (
        F.when(load & (family == WATER_FAMILY), "Water Load")
        .when(load & (family == COOLING_FAMILY), "Cooling Load")
        .when((category == "Water") & (family == COMBINED_FAMILY), "Water")
    )
    return deltas.withColumn("energy_category_disagg", cause).where(F.col("energy_category_disagg").isNotNull())


def imbalance_ranking(disaggregated: DataFrame, period: int | None = 2050, by: list[str] | None = None) -> DataFrame:
    """Total imbalance (load increase plus hydropower decrease) per scenario, and its order."""
    by = by or []
    chosen = disaggregated if period is None else disaggregated.where(F.col("ts_period") == period)
    delta = F.col("Delta_AnnualGen_GWh")
    adjusted = chosen.withColumn(
        "Adj_Delta_AnnualGen_GWh", F.when(F.col("energy_category_disagg") == "Water", -delta).otherwise(delta)
    )
    keys = [*by, "ts_period", "Scenario"]
    total = with_total(adjusted, "Adj_Delta_AnnualGen_GWh", keys, "TotalImbalance_GWh", few_rows=True)
    return rank_by_total(total, "Scenario", "TotalImbalance_GWh", "scenario_rank")


def load_dispatch_tx_delta(zone_loads: DataFrame, baseline: str = BASELINE) -> dict[str, DataFrame]:
    """Deltas of the load balance by zone, for the system and for the US zones.

    Demand is negative in the balance, so its difference is taken between absolute values.
    """
    mode = {"zone_demand_GWh": "abs"}
    zone = scenario_delta(zone_loads, baseline, ["load_zone", "Year", "ts_period"], LOADS, mode)
    keys = ["Scenario", "Baseline_Scenario", "Year", "ts_period"]
    return {
        "zone": zone,
        "system": rollup_delta(zone, keys, LOADS, mode),
        "us": rollup_delta(zone.where(is_us_zone("load_zone")), keys, LOADS, mode),
    }


def cost_report(costs: DataFrame, baseline: str = BASELINE, period_years: int = 5) -> dict[str, DataFrame]:
    """Period costs by component, per period and over all periods, with deltas."""
    items = costs.where(F.col("Component") != "EmissionsCosts").withColumns(
        {f"PeriodCost_{k}": F.col(f"AnnualCost_{k}") * period_years for k in ("Real", "NPV")}
    )
    measures = [*COSTS]
    delta = scenario_delta(items, baseline, ["PERIOD", "Component", "Component_type"], COSTS)
    summed = [*measures, *[f"{m}_baseline" for m in measures], *[d for d, _ in COSTS.values()]]

    def totals(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(*[na_sum(c).alias(c) for c in columns])

    overall = totals(delta, ["Scenario", "Baseline_Scenario"], summed).withColumns(
        {
            f"TotalCost_{k}_perc_change_from_baseline": r_div(
                f"Delta_PeriodCost_{k}", f"PeriodCost_{k}_baseline"
            )
            for k in ("NPV", "Real")
        }
    )
    return {
        "items": items,
        "item_delta": delta,
        "period": totals(items, ["PERIOD", "Scenario"], measures),
        "period_delta": totals(delta, ["PERIOD", "Scenario", "Baseline_Scenario"], summed),
        "total": totals(items, ["Scenario"], measures),
        "total_delta": overall,
    }


def hourly_loads(load_balance: DataFrame, timepoints: DataFrame, timeseries: DataFrame) -> DataFrame:
    """Load balance rows with their calendar parts and sampling weights."""
    keys = [c for c in ("Scenario",) if c in timepoints.columns and c in timeseries.columns]
    points = match(timepoints, timeseries, {"timeseries": "TIMESERIES", **{k: k for k in keys}})
    return match(with_compact_parts(load_balance), points, ["timestamp", *keys])


def monthly_load_delta(
    hourly: DataFrame, baseline: str = BASELINE, period_years: int = 5
) -> dict[str, DataFrame]:
    """Monthly loads by zone; deltas (baseline minus scenario); positive system and US deltas."""
    scale = F.col("ts_scale_to_period") / F.lit(period_years)
    monthly = hourly.groupBy("Scenario", "load_zone", "Month", "Year", "ts_period").agg(
        *[na_sum(F.col(m) * scale).alias(m) for m in LOAD_MEASURES]
    )
    names = {m: (f"Delta_{m}", f"{m}_perc_change_from_baseline") for m in LOAD_MEASURES}
    zone = scenario_delta(monthly, baseline, ["ts_period", "load_zone", "Month", "Year"], names, "reversed")

    def total(df: DataFrame) -> DataFrame:
        positive = df.groupBy("Scenario", "Month", "Year", "ts_period").agg(
            (-na_sum("zone_demand_mw_baseline")).alias("zone_demand_mw_baseline"),
            (-na_sum("zone_demand_mw")).alias("zone_demand_mw"),
        )
        return add_differences(
            positive, {"zone_demand_mw": ("Delta_zone_demand_mw", "Delta_perc_zone_demand_mw")}, ndigits=None
        )

    return {"monthly": monthly, "zone": zone, "system": total(zone), "us": total(zone.where(is_us_zone("load_zone")))}


def system_duration_curve(hourly: DataFrame) -> DataFrame:
    """Sampled system load ranked from the highest hour down per scenario and period."""
    system = hourly.groupBy(
        "Scenario", "timestamp", "Month", "Year", "Day", "Hour_UTC", "date_time_UTC", "ts_period", "ts_scale_to_period"
    ).agg(na_sum("zone_demand_mw").alias("zone_demand_mw"))
    return duration_curve(system, "zone_demand_mw", ["Scenario", "ts_period"], ["timestamp"])


def hourly_dispatch(dispatch: DataFrame, zone: str = "America/Los_Angeles") -> dict[str, DataFrame]:
    """Dispatch and curtailment per hour and source, by load zone and for the system.

    Curtailment counts for solar and wind only.
    """
    tagged = with_compact_parts(with_source(dispatch)).withColumns(
        {
            "Hour_local": local_hour("date_time_UTC", zone),
            "day_type": day_type_of("tp_weight_in_year_hrs"),
            "Season": season_of("Month"),
        }
    )
    hour = [
        "Scenario",
        "gen_energy_source",
        "period",
        "Month",
        "Day",
        "Hour_UTC",
        "date_time_UTC",
        "Hour_local",
        "day_type",
        "tp_weight_in_year_hrs",
        "Season",
    ]
    sums = [na_sum(c).alias(c) for c in ("DispatchGen_MW", "Curtailment_MW")]
    by_zone = tagged.groupBy("gen_load_zone", *hour).agg(*sums)
    by_zone = by_zone.withColumn(
        "Curtailment_MW", zero_unless("Curtailment_MW", "gen_energy_source", ["Solar", "Wind"])
    )
    return {"zone": by_zone, "system": by_zone.groupBy(*hour).agg(*sums)}


def seasonal_dispatch(system: DataFrame) -> DataFrame:
    """Mean dispatch by season, day type, hour and source; total curtailment as one more source.

    Each mean becomes two rows, its source's dispatch and its share of the curtailment, which are
    summed once more: the hourly rows are read once.
    """
    keys = ["Scenario", "Season", "period", "Hour_local", "day_type"]
    means = system.groupBy(*keys, "gen_energy_source").agg(
        na_mean("DispatchGen_MW").alias("DispatchGen_MW"), na_mean("Curtailment_MW").alias("Curtailment_MW")
    )
    rows = F.array(
        F.struct(F.col("gen_energy_source").alias("source"), F.col("DispatchGen_MW").alias("mw")),
        F.struct(F.lit("Curtailment").alias("source"), F.col("Curtailment_MW").alias("mw")),
    )
    long = means.select(*keys, F.inline(rows))
    return long.groupBy(*keys, F.col("source").alias("gen_energy_source")).agg(na_sum("mw").alias("DispatchGen_MW"))


def seasonal_dispatch_delta(seasonal: DataFrame, baseline: str = BASELINE, dense: bool = True) -> DataFrame:
    """Seasonal deltas; with ``dense``, every combination of the keys has a row (zeros where absent)."""
    keys = ["Season", "period", "Hour_local", "day_type", "gen_energy_source"]
    names = {"DispatchGen_MW": ("Delta_DispatchGen_MW", "DispatchGen_perc_change_from_baseline")}
    delta = scenario_delta(seasonal, baseline, keys, names)
    if not dense:
        return delta
    return densify(delta, ["Scenario", *keys], {"Delta_DispatchGen_MW": 0.0, "DispatchGen_MW": 0.0})


def focus_dispatch(
    dense_delta: DataFrame, scenario: str, day_type: str = "peak_day", period: int = 2050
) -> DataFrame:
    """One scenario, day type and period of the dense table, restricted to rows with a baseline and
    densified again over the hours, sources and seasons that remain."""
    chosen = dense_delta.where(
        (F.col("Scenario") == scenario) & (F.col("day_type") == day_type) & (F.col("period") == period)
    ).where(F.col("DispatchGen_MW_baseline").isNotNull())
    keys = ["Hour_local", "gen_energy_source", "period", "Season", "Scenario", "day_type"]
    fill = {"Delta_DispatchGen_MW": 0.0, "DispatchGen_MW": 0.0, "DispatchGen_MW_baseline": 0.0}
    return densify(chosen, keys, fill)


def hydro_monthly_delta(system: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Monthly hydropower energy (power times hour weight) and its unrounded delta."""
    energy = (
        system.where(F.col("gen_energy_source") == "Water")
        .groupBy("Scenario", "gen_energy_source", "period", "Month")
        .agg(na_sum(F.col("tp_weight_in_year_hrs") * F.col("DispatchGen_MW")).alias("Monthly_DispatchGen_MW"))
    )
    names = {"Monthly_DispatchGen_MW": ("Delta_Monthly_DispatchGen_MW", "PercDelta_Monthly_DispatchGen_MW")}
    return scenario_delta(energy, baseline, ["period", "Month", "gen_energy_source"], names, ndigits=None)


def monthly_load_hydro_box(
    system_load: DataFrame, hydro: DataFrame, year: int | None = 2050
) -> dict[str, DataFrame]:
    """Monthly load and hydropower deltas in long form, and their five-number summary by month."""
    right = hydro.select("Scenario", "Month", F.col("period").alias("ts_period"), "Delta_Monthly_DispatchGen_MW")
    joined = match(system_load, right, ["Scenario", "Month", "ts_period"])
    ids = ["Scenario", "Month", "Year"]
    measures = ["Delta_Monthly_DispatchGen_MW", "Delta_zone_demand_mw"]
    long = to_long(
        joined.select(*ids, *measures), ids, measures, "Demand_or_Supply", "DeltaMonthly_Dispatch_or_Load_MW"
    )
    labels = {"Delta_Monthly_DispatchGen_MW": "Supply", "Delta_zone_demand_mw": "Demand"}
    long = long.withColumn("Demand_or_Supply", relabel("Demand_or_Supply", labels))
    chosen = long if year is None else long.where(F.col("Year") == year)
    return {
        "long": long,
        "box": five_number(chosen, "DeltaMonthly_Dispatch_or_Load_MW", ["Demand_or_Supply", "Month"]),
    }


def numeric_builds(transmission: DataFrame) -> DataFrame:
    return transmission.withColumn("BuildTx", number_or_zero("BuildTx"))


def tx_lines(transmission: DataFrame) -> DataFrame:
    """New build per line and period as a number, with its running total along the periods."""
    by = ["Scenario", "TRANSMISSION_LINE", "trans_lz1", "trans_lz2"]
    built = numeric_builds(transmission)
    return running_total(built, "BuildTx", by, ["PERIOD"], "cumulative_BuiltTx_MW", few_rows=True)


def tx_balance(system: DataFrame) -> DataFrame:
    """Running new build and existing capacity of (Scenario, PERIOD) totals."""
    running = running_total(system, "BuildTx", ["Scenario"], ["PERIOD"], "cumulative_BuiltTx_MW", few_rows=True)
    return running.withColumn("existing_Tx_MW", F.col("TxCapacityNameplate") - F.col("BuildTx"))


def tx_long(balance: DataFrame) -> DataFrame:
    columns = ["BuildTx", "TxCapacityNameplate", "cumulative_BuiltTx_MW", "existing_Tx_MW"]
    ids = ["Scenario", "PERIOD"]
    long = to_long(balance.select(*ids, *columns), ids, columns, "Tx_type", "MW_Tx")
    return long.withColumn("Tx_type", relabel("Tx_type", TX_TYPES))


def tx_delta(long: DataFrame, baseline: str = BASELINE) -> DataFrame:
    names = {"MW_Tx": ("Delta_MW_Tx", "Tx_perc_change_from_baseline")}
    return scenario_delta(long, baseline, ["PERIOD", "Tx_type"], names)


def tx_report(transmission: DataFrame, baseline: str = BASELINE) -> dict[str, DataFrame]:
    """Transmission builds by line, for the system, long by type, and the deltas."""
    totals = numeric_builds(transmission).groupBy("Scenario", "PERIOD").agg(
        na_sum("BuildTx").alias("BuildTx"), na_sum("TxCapacityNameplate").alias("TxCapacityNameplate")
    )
    balance = tx_balance(totals)
    long = tx_long(balance)
    return {"lines": tx_lines(transmission), "system": balance, "long": long, "delta": tx_delta(long, baseline)}


def tx_edges(transmission: DataFrame, zones: DataFrame, centroids: DataFrame) -> DataFrame:
    """Lines with the names and coordinates of both ends, in GW, with the total new build per line."""
    ends = F.split("TRANSMISSION_LINE", "-", 3)
    gigawatts = {
        "nameplate_GW": thousandth("TxCapacityNameplate"),
        "existing_trans_cap_GW": thousandth("existing_trans_cap"),
        "BuildTx_GW": thousandth(number_or_zero("BuildTx")),
    }
    lines = transmission.withColumns(
        {
            "zone_id1": ends[0].try_cast("int"),
            "zone_id2": F.try_element_at(ends, F.lit(2)).try_cast("int"),
            **gigawatts,
        }
    )
    places = match(centroids.select("LOAD_AREA", "X", "Y"), zones, {"LOAD_AREA": "LOAD_ZONE"})

    def end(n: int) -> DataFrame:
        return places.select(
            "zone_dbid",
            F.col("LOAD_AREA").alias(f"LOAD_ZONE{n}"),
            F.col("X").alias(f"X{n}"),
            F.col("Y").alias(f"Y{n}"),
        )

    joined = match(match(lines, end(1), {"zone_id1": "zone_dbid"}), end(2), {"zone_id2": "zone_dbid"})
    line = ["TRANSMISSION_LINE", "trans_lz1", "trans_lz2", "zone_id1", "zone_id2", "LOAD_ZONE1", "LOAD_ZONE2"]
    by = [c for c in ("Scenario",) if c in transmission.columns] + line
    return with_total(joined, "BuildTx_GW", by, "total_new_BuildTx_GW", few_rows=True)


def tx_edges_long(edges: DataFrame) -> DataFrame:
    measures = {"nameplate_GW": "Total Tx Nameplate Capacity", "existing_trans_cap_GW": "Existing Tx Capacity"}
    ids = [c for c in edges.columns if c not in measures]
    long = to_long(edges, ids, list(measures), "Tx_type", "Tx_GW")
    return long.withColumn("Tx_type", relabel("Tx_type", measures))


def zone_map_table(
    zone_delta: DataFrame, centroids: DataFrame, periods: list[int] | None = None
) -> DataFrame:
    """Capacity deltas for every zone, source and period of a scenario, with zone coordinates."""
    levels = {"PERIOD": periods or [int(p) for p in PERIOD_LABELS[1:6]]}
    keys = ["Scenario", "gen_load_zone", "gen_energy_source", "PERIOD"]
    dense = densify(zone_delta, keys, {}, levels, keep=["Scenario"])
    inside = dense.where(F.col("PERIOD").isin(levels["PERIOD"]))
    return match(inside, centroids, {"gen_load_zone": "LOAD_AREA"})


def zone_source_mix(
    map_table: DataFrame, scenario: str, period: int = 2050, sources: list[str] | None = None
) -> DataFrame:
    """Baseline capacity per source in one row per zone; the radius makes areas proportional to the baseline's zone total.

    Missing capacities are left out of the sums; a source the zone lacks is 0.
    """
    chosen = map_table.where((F.col("Scenario") == scenario) & (F.col("PERIOD") == period))
    keys = ["PERIOD", "gen_load_zone", "X", "Y"]
    value = "GenCapacityCumulative_MW_baseline"
    sources = sources or [s for s in ENERGY_SOURCES if s != "Curtailment"]
    wide = pivot_fill(chosen, keys, "gen_energy_source", value, sources, fill=0.0, skip_nulls=True)
    total = chosen.groupBy(*keys).agg(F.max("Total_Lz_GenCap_MW_baseline").alias("Total_Lz_GenCap_MW_baseline"))
    return match(wide, total, keys).withColumn("radius", F.sqrt(F.col("Total_Lz_GenCap_MW_baseline") / F.lit(pi)))


def slopes_with_centroids(slopes: DataFrame, centroids: DataFrame, us_only: bool = True) -> DataFrame:
    """Yearly mean load response per zone with its coordinates."""
    placed = match(slopes, centroids, {"load_zone_name": "LOAD_AREA"})
    return placed.where(is_us_zone("load_zone_name")) if us_only else placed
