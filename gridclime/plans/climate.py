"""Catchment climate: monthly series, regional changes and their relation to energy changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import na_sum
from ..functions.recode import ENERGY_CATEGORY_LABELS, region_of, relabel, state_of_zone
from ..functions.units import depth_to_km3
from ..operators.grouped import fit_columns, mixed_rollup
from ..operators.matching import match
from ..operators.ordered import strided_mean

CATCHMENT = ["Catchment_num", "Catchment_name", "State", "Region"]
TEMPERATURES = ["tavg.C", "Tavg.C"]
PRECIPITATION = "Prcp.mm"
HISTORICAL = "Hist"


def catchment_climate(
    data: DataFrame,
    bands: DataFrame,
    historical: str = HISTORICAL,
    scenario_years: tuple[int, int] = (2010, 2060),
    historical_years: tuple[int, int] = (1980, 2010),
    stride: int = 12,
    half_width: int = 5,
) -> DataFrame:
    """Mean temperature and precipitation volume per catchment and month, with moving means.

    ``data`` is long by variable and elevation band, ``bands`` gives the band areas. The historical
    run is not averaged, and only the others' rows enter the moving means. Both variables are reduced in one pass over the data.
    """
    site = ["Scenario", "Catchment_num", "Catchment_name", "State"]
    month = [*site, "Year", "Month"]
    variable, km3 = F.col("Var_type"), depth_to_km3("value", "area_ha")
    warmth = variable.isin(TEMPERATURES)
    rain = variable == PRECIPITATION
    placed = rain & F.col("total_catchment_area_km2").isNotNull()
    sums = match(data, bands, [*site, "Elevation"]).groupBy(*month).agg(
        F.avg(F.when(warmth, F.col("value"))).alias("_tavg"),
        F.count(F.when(warmth & F.col("value").isNull(), 1)).alias("_tavg_missing"),
        F.count(F.when(warmth, 1)).alias("_tavg_rows"),
        F.sum(F.when(placed, km3)).alias("_km3"),
        F.count(F.when(placed & km3.isNull(), 1)).alias("_km3_missing"),
        F.count(F.when(placed, 1)).alias("_placed"),
        F.count(F.when(rain & ~placed, 1)).alias("_unplaced"),
        F.max("total_catchment_area_km2").alias("_area"),
    )
    # precipitation of bands without an area stays apart, as a row without area and volume
    volume = F.when(F.col("_km3_missing") == 0, F.col("_km3"))
    nothing = F.lit(None).cast("double")
    rows = F.array_compact(
        F.array(
            F.when(F.col("_placed") > 0, F.struct(F.col("_area").alias("area"), volume.alias("km3"))),
            F.when(
                (F.col("_unplaced") > 0) | (F.col("_placed") == 0),
                F.struct(nothing.alias("area"), nothing.alias("km3")),
            ),
        )
    )
    past = F.col("Scenario") == historical
    years = F.when(past, F.col("Year").between(*historical_years)).otherwise(F.col("Year").between(*scenario_years))
    monthly = (
        sums.where((F.col("_tavg_rows") > 0) & years)
        .withColumn("_row", F.explode(rows))
        .select(
            *month,
            F.when(F.col("_tavg_missing") == 0, F.col("_tavg")).alias("tavg_C"),
            F.col("_row.area").alias("total_catchment_area_km2"),
            F.col("_row.km3").alias("Precip_km3"),
        )
    )
    means = {"Precip_km3": "avg_Precip_km3", "tavg_C": "avg_tavg_C"}
    averaged = strided_mean(
        monthly.where(F.col("Scenario") != historical), means, site, ["Year", "Month"], stride, half_width, include_last=False
    )
    as_is = monthly.where(past).withColumns({mean: F.col(value) for value, mean in means.items()})
    return averaged.unionByName(as_is).withColumn("Region", region_of("State"))


def historical_means(monthly: DataFrame, historical: str = HISTORICAL) -> DataFrame:
    """Mean annual temperature and precipitation of the historical run per catchment."""
    by = [*CATCHMENT, "total_catchment_area_km2"]
    months = mixed_rollup(
        monthly.where(F.col("Scenario") == historical),
        [*by, "Month"],
        {"avg_tavg_C": "hist_avg_tavg_C", "avg_Precip_km3": "hist_avg_Precip_km3"},
        {},
    )
    return mixed_rollup(
        months,
        by,
        {"hist_avg_tavg_C": "annual_hist_avg_tavg_C"},
        {"hist_avg_Precip_km3": "annual_hist_avg_Precip_km3"},
    )


def climate_delta_by_catchment(monthly: DataFrame, historical: str = HISTORICAL) -> DataFrame:
    by = [*CATCHMENT, "total_catchment_area_km2"]
    annual = mixed_rollup(
        monthly.where(F.col("Scenario") != historical),
        ["Scenario", *by, "Year"],
        {"avg_tavg_C": "annual_avg_tavg_C"},
        {"avg_Precip_km3": "annual_total_Precip_km3"},
    )
    return match(annual, historical_means(monthly, historical), by).withColumns(
        {
            "delta_annual_avg_tavg_C": F.col("annual_avg_tavg_C") - F.col("annual_hist_avg_tavg_C"),
            "delta_annual_total_Precip_km3": F.col("annual_total_Precip_km3") - F.col("annual_hist_avg_Precip_km3"),
        }
    )


def climate_delta_by_region(monthly: DataFrame, historical: str = HISTORICAL) -> DataFrame:
    """Annual changes from the historical means, temperatures averaged and volumes summed by region."""
    means = ["delta_annual_avg_tavg_C", "annual_avg_tavg_C", "annual_hist_avg_tavg_C"]
    sums = ["delta_annual_total_Precip_km3", "annual_total_Precip_km3", "annual_hist_avg_Precip_km3"]
    return mixed_rollup(
        climate_delta_by_catchment(monthly, historical),
        ["Scenario", "Year", "Region"],
        {m: m for m in means},
        {**{s: s for s in sums}, "total_catchment_area_km2": "total_region_area_km2"},
    )


def regional_energy(energy: DataFrame, period: int | None = 2050) -> DataFrame:
    """Zone energy deltas of one period summed by region."""
    chosen = energy if period is None else energy.where(F.col("ts_period") == period)
    measures = ["Energy_GWh_typical_yr", "Energy_GWh_typical_yr_baseline", "Delta_AnnualGen_GWh"]
    return (
        chosen.withColumn("Region", region_of(state_of_zone("load_zone")))
        .groupBy(
            "ts_period",
            "energy_category",
            "Scenario",
            "Baseline_Scenario",
            "climate_impacts_included",
            "energy_category_disagg",
            "Region",
        )
        .agg(*[na_sum(m).alias(m) for m in measures])
    )


def climate_vs_energy_fit(
    energy: DataFrame, regional_climate: DataFrame, period: int = 2050, aliases: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """Energy deltas next to climate deltas, and the R2 of both regressors per cause and region.

    ``aliases`` renames climate scenarios to the spelling of the energy results.
    """
    climate = regional_climate.where(F.col("Year") == period)
    if aliases:
        climate = climate.withColumn("Scenario", relabel("Scenario", aliases))
    joined = match(
        regional_energy(energy, period), climate, {"Scenario": "Scenario", "ts_period": "Year", "Region": "Region"}
    )
    by = ["energy_category_disagg", "Region"]
    fits = joined.groupBy(*by).agg(
        *fit_columns("Delta_AnnualGen_GWh", "delta_annual_avg_tavg_C", "temp_"),
        *fit_columns("Delta_AnnualGen_GWh", "delta_annual_total_Precip_km3", "precip_"),
    )
    points = match(joined, fits.select(*by, "temp_r2", "precip_r2"), by)
    label = relabel("energy_category_disagg", ENERGY_CATEGORY_LABELS)
    return {
        "points": points.withColumn("energy_category_disagg", label),
        "fits": fits.withColumn("energy_category_disagg", label),
    }
