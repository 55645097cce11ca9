"""Unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col


def thousandth(c: Column | str) -> Column:
    """MW to GW, MWh to GWh, GWh to TWh."""
    return _col(c) / F.lit(1000.0)


def thousandfold(c: Column | str) -> Column:
    """GWh to MWh, GW to MW."""
    return _col(c) * F.lit(1000.0)


def hectares_to_km2(c: Column | str) -> Column:
    return _col(c) * F.lit(0.01)


def depth_to_km3(mm: Column | str, hectares: Column | str) -> Column:
    """Millimetres of water over an area in hectares as cubic kilometres."""
    return _col(mm) * F.lit(1e-6) * hectares_to_km2(hectares)


def negated(c: Column | str) -> Column:
    return -_col(c)


def average_megawatt(gwh: Column | str, days: Column | str) -> Column:
    return thousandfold(gwh) / (_col(days) * F.lit(24))
