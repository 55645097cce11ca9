"""Category recodes as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col

# The labels of the input files and of the published tables.
BIOMASS_FUELS = ["Bio_Gas", "Bio_Liquid", "Bio_Solid"]
OIL_FUELS = ["DistillateFuelOil", "ResidualFuelOil"]
ENERGY_SOURCES = [
    "Curtailment",
    "Battery Storage",
    "Solar",
    "Wind",
    "Biomass",
    "Geothermal",
    "Gas",
    "Coal",
    "Oil",
    "Waste Heat",
    "Uranium",
    "Water",
]
SEASONS = ["Winter", "Spring", "Summer", "Fall"]
PERIOD_LABELS = ["pre-2030", "2030", "2035", "2040", "2045", "2050", "2055"]
TX_TYPES = {
    "BuildTx": "New Tx Capacity Built",
    "existing_Tx_MW": "Existing Tx Capacity",
    "cumulative_BuiltTx_MW": "Cumulative New Tx Capacity Built",
    "TxCapacityNameplate": "Total Tx Nameplate Capacity",
}
ENERGY_CATEGORY_LABELS = {"Water": "Hydropower", "Cooling Load": "Cooling/Heating Load"}
NON_US_ZONES = ["CAN_ALB", "CAN_BC", "MEX_BAJA"]
STATE_REGIONS = {
    "MT": ["CO", "UT", "ID", "WY", "MT"],
    "PacNW": ["WA", "OR"],
    "CAN": ["CAN"],
}
OTHER_REGION = "SW"
TECHNOLOGY_GROUPS = {
    "Wind": ["Wind", "Offshore_Wind"],
    "Solar": ["Central_PV", "Commercial_PV", "Residential_PV"],
    "Thermal": [
        "Gas_Steam_Turbine_Cogen",
        "Gas_Internal_Combustion_Engine",
        "Gas_Internal_Combustion_Engine_Cogen",
        "DistillateFuelOil_Internal_Combustion_Engine",
        "Gas_Steam_Turbine",
        "Gas_Combustion_Turbine",
        "Gas_Combustion_Turbine_Cogen",
        "CCGT",
        "CCGT_Cogen",
        "ST",
        "DistillateFuelOil_Combustion_Turbine",
        "GT",
        "OT",
    ],
    "Coal": ["Coal_Steam_Turbine_Cogen", "Coal_IGCC", "Coal_Steam_Turbine"],
    "Biomass": [
        "Bio_Gas_Steam_Turbine",
        "Bio_Solid_Steam_Turbine",
        "Bio_Gas",
        "Bio_Liquid_Steam_Turbine_Cogen",
        "Bio_Gas_Internal_Combustion_Engine",
        "Bio_Solid_Steam_Turbine_Cogen",
        "Bio_Gas_Internal_Combustion_Engine_Cogen",
    ],
    "Geothermal": ["Geothermal"],
    "CSP": ["CSP_Trough_6h_Storage", "CSP_Trough_No_Storage"],
    "Storage": ["Battery_Storage"],
    "CompAir": ["Compressed_Air_Energy_Storage"],
    "Hydro": ["Hydro_NonPumped"],
    "Pumped Hydro": ["Hydro_Pumped"],
    "Nuclear": ["Nuclear"],
}
TECHNOLOGY_ORDER = [
    "Coal",
    "Thermal",
    "Nuclear",
    "Geothermal",
    "Biomass",
    "Hydro",
    "Pumped Hydro",
    "Wind",
    "CSP",
    "Solar",
    "Storage",
]


@dataclass(frozen=True)
class Period:
    """An investment period: the years it covers and the year that names it."""

    label: str
    start_year: int
    end_year: int

    @property
    def length(self) -> int:
        return self.end_year - self.start_year + 1


# The five investment periods, five years each.
PERIODS = [Period(str(y), y - 2, y + 2) for y in range(2030, 2051, 5)]


def relabel(c: Column | str, names: dict[str, str]) -> Column:
    """Replace listed values; keep all others."""
    c = _col(c)
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(names.items())])
    return F.coalesce(F.try_element_at(lookup, c), c)


def normalise_source(source: Column | str, tech: Column | str) -> Column:
    """Fuel to energy source. The storage technology wins over whatever fuel it names."""
    s = _col(source)
    return (
        F.when(_col(tech) == "Battery_Storage", "Battery Storage")
        .when(s == "Waste_Heat", "Waste Heat")
        .when(s.isin(BIOMASS_FUELS), "Biomass")
        .when(s.isin(OIL_FUELS), "Oil")
        .otherwise(s)
    )


def technology_group(tech: Column | str) -> Column:
    t = _col(tech)
    expr = F
    for group, members in TECHNOLOGY_GROUPS.items():
        expr = expr.when(t.isin(members), group)
    return expr


def rank_in(c: Column | str, levels: list[str]) -> Column:
    """1-based display rank of a value in an explicit order, null when it is not listed."""
    position = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.when(position > 0, position.cast("int"))


def bin_period(
    year: Column | str,
    periods: list[Period] | None = None,
    before: str = "pre-2030",
    after: str | None = "2055",
) -> Column:
    """Year to period label; years past the last period get ``after`` (kept as an ordinary value)."""
    y = _col(year)
    periods = PERIODS if periods is None else periods
    expr = F.when(y.isNull(), F.lit(None).cast("string"))
    for p in periods:
        expr = expr.when(y.between(p.start_year, p.end_year), p.label)
    expr = expr.when(y > max(p.end_year for p in periods), after)
    return expr.otherwise(before)


def region_of(state: Column | str) -> Column:
    s = _col(state)
    expr = F
    for region, states in STATE_REGIONS.items():
        expr = expr.when(s.isin(states), region)
    return expr.otherwise(OTHER_REGION)


def state_of_zone(zone: Column | str) -> Column:
    """State code in front of the first underscore of the zone's first three characters."""
    return F.substring_index(F.substring(_col(zone), 1, 3), "_", 1)


def is_us_zone(zone: Column | str) -> Column:
    return ~_col(zone).isin(NON_US_ZONES)
