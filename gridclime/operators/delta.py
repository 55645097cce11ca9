"""Comparison of every scenario with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import na_sum, r_div

# measure -> (name of the difference, name of the relative change)
Names = dict[str, tuple[str, str]]


def _names(measures: list[str] | Names) -> Names:
    if isinstance(measures, dict):
        return measures
    return {m: (f"delta_{m}", f"{m}_perc_change_from_baseline") for m in measures}


def _difference(value: Column, base: Column, mode: str, ndigits: int | None) -> tuple[Column, Column]:
    if mode == "plain":
        delta, over = value - base, base
    elif mode == "abs":
        delta, over = F.abs(value) - F.abs(base), F.abs(base)
    elif mode == "reversed":
        delta, over = base - value, base
    else:
        raise ValueError(f"unknown mode {mode!r}: use plain, abs or reversed")
    change = r_div(delta, over)
    return delta, change if ndigits is None else F.round(change, ndigits)


def _mode_of(mode: str | dict[str, str], measure: str) -> str:
    return mode if isinstance(mode, str) else mode.get(measure, "plain")


def add_differences(
    df: DataFrame,
    measures: list[str] | Names,
    mode: str | dict[str, str] = "plain",
    ndigits: int | None = 3,
    suffix: str = "_baseline",
) -> DataFrame:
    columns = {}
    for m, (delta, change) in _names(measures).items():
        d, c = _difference(F.col(m), F.col(f"{m}{suffix}"), _mode_of(mode, m), ndigits)
        columns[delta], columns[change] = d, c
    return df.withColumns(columns)


def scenario_delta(
    df: DataFrame,
    baseline: str,
    keys: list[str],
    measures: list[str] | Names,
    mode: str | dict[str, str] = "plain",
    ndigits: int | None = 3,
    how: str = "left",
    scenario: str = "Scenario",
    suffix: str = "_baseline",
    scenarios: list[str] | None = None,
) -> DataFrame:
    """Every non-baseline row next to the baseline row with the same keys.

    Adds ``Baseline_Scenario``, ``<measure>_baseline``, the difference and the relative change
    (x/0 infinite, 0/0 NaN). ``how='left'`` keeps scenario rows only, ``how='full'`` also gives
    every scenario the baseline rows it lacks (retirements). ``mode`` may differ by measure. The
    baseline's other columns come along too, as ``<column>_baseline``, but for those whose name is
    taken; a measure's baseline always comes from the baseline row, and replaces a column of that name.

    Several baseline rows of a key combination give as many rows each (see quality.duplicate_keys).
    The rows of a key combination, one per scenario, meet in one shuffle of the given table, so
    whatever produced the table runs once; null keys match null keys. ``scenarios`` lists those that
    ``full`` gives the baseline's rows; where it is not given, they are looked up in the table when
    this is called.
    """
    names = _names(measures)
    if how not in ("left", "full"):
        raise ValueError(f"unknown join {how!r}: use left or full")
    same_keys = Window.partitionBy(*keys)
    is_base = F.col(scenario) == baseline
    replaced = [f"{m}{suffix}" for m in names]
    carried = [
        c for c in df.columns if c not in (*keys, scenario, *replaced) and (c in names or f"{c}{suffix}" not in df.columns)
    ]
    base = F.struct(*carried)
    others = F.col(scenario) != baseline
    paired = df.withColumn("_bases", F.collect_list(F.when(is_base, base)).over(same_keys))
    if how == "left":
        paired = paired.where(others).withColumn("_base", F.explode_outer("_bases"))
    else:
        if scenarios is None:
            listed = df.where(others).select(scenario).distinct().collect()
            scenarios = sorted(r[0] for r in listed)
        wanted = F.array(*[F.lit(s) for s in scenarios]).cast("array<string>")
        found = F.collect_set(F.when(others, F.col(scenario))).over(same_keys)
        paired = paired.withColumn("_lacking", F.array_except(wanted, found))
        # a baseline row stands for itself in each scenario that lacks its keys
        stand_in = F.transform("_lacking", lambda s: F.struct(s.alias("name"), base.alias("base")))
        own = F.transform(F.when(F.size("_bases") > 0, F.col("_bases")).otherwise(F.array(F.lit(None))), lambda b: F.struct(F.col(scenario).alias("name"), b.alias("base")))
        paired = paired.withColumn("_pair", F.explode(F.when(is_base, stand_in).when(others, own)))
        left_out = [c for c in df.columns if c not in (*keys, scenario)]
        paired = paired.withColumns(
            {"_base": F.col("_pair.base"), scenario: F.col("_pair.name"), **{c: F.when(~is_base, F.col(c)) for c in left_out}}
        ).drop("_pair", "_lacking")
    both = paired.withColumns(
        {
            "Baseline_Scenario": F.when(F.col("_base").isNotNull(), F.lit(baseline)),
            **{f"{m}{suffix}": F.col(f"_base.{m}") for m in carried},
        }
    ).drop("_base", "_bases")
    return add_differences(both, names, mode, ndigits, suffix)


def rollup_delta(
    delta: DataFrame,
    keys: list[str],
    measures: list[str] | Names,
    mode: str | dict[str, str] = "plain",
    ndigits: int | None = 3,
    skip_nulls: bool = False,
    suffix: str = "_baseline",
) -> DataFrame:
    """Sum both sides of a delta table to coarser keys, then recompute difference and change."""
    names = _names(measures)
    both = [c for m in names for c in (m, f"{m}{suffix}")]
    summed = delta.groupBy(*keys).agg(*[na_sum(c, skip_nulls).alias(c) for c in both])
    return add_differences(summed, names, mode, ndigits, suffix)


def drop_undefined_change(df: DataFrame, change: str) -> DataFrame:
    """Drop rows whose relative change is missing or 0/0; infinite changes stay."""
    c = F.col(change)
    return df.where(c.isNotNull() & ~F.isnan(c))
