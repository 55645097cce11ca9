"""Joins in which null keys match each other, total-on-rows, fallback lookup, range lookup, grids."""

from __future__ import annotations

from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.missing import na_sum
from ..session import staged


def match(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | dict[str, str],
    how: str = "left",
    nullable: bool = True,
) -> DataFrame:
    """Join on ``keys`` (a list, or left name to right name), keeping one copy of each key.

    Null keys match null keys. Set ``nullable=False`` for keys that are never null: the plain
    equality lets Spark reuse an existing partitioning of either side.
    No broadcast hint is given; Spark broadcasts a side it has measured to be small.
    """
    pairs = {k: k for k in keys} if isinstance(keys, list) else dict(keys)
    tag = {r: f"__match_{r}" for r in pairs.values()}
    right = right.withColumnsRenamed(tag)
    conditions = [
        F.col(l).eqNullSafe(F.col(tag[r])) if nullable else F.col(l) == F.col(tag[r]) for l, r in pairs.items()
    ]
    joined = left.join(right, reduce(lambda a, b: a & b, conditions), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full"):
        joined = joined.withColumns({l: F.coalesce(F.col(l), F.col(tag[r])) for l, r in pairs.items()})
    return joined.drop(*tag.values())


def with_total(
    df: DataFrame, value: str, by: list[str], name: str, skip_nulls: bool = False, few_rows: bool = False
) -> DataFrame:
    """Keep the rows and add the group total of ``value``.

    Groups of any size are aggregated first and matched back, which moves only one row per group and
    task. ``few_rows`` says that a group is one row per category (the sources of a zone, the periods
    of a line); then a window gives the total without a second pass over the input.
    """
    if few_rows:
        whole = Window.partitionBy(*by)
        v = F.col(value)
        total = F.sum(v).over(whole)
        if not skip_nulls:
            total = F.when(F.count(v).over(whole) == F.count(F.lit(1)).over(whole), total)
        return df.withColumn(name, total)
    totals = df.groupBy(*by).agg(na_sum(value, skip_nulls).alias(name))
    return match(df, totals, by)


def fallback_lookup(
    df: DataFrame,
    own: str,
    zone: str,
    zone_values: DataFrame,
    nearest: DataFrame,
    by: dict[str, str],
    zone_column: str,
    zone_value: str,
    nearest_from: str,
    nearest_to: str,
    name: str,
) -> DataFrame:
    """Own value where there is one, else the value of the lookup zone.

    The lookup zone is the mapped neighbour where the zone is listed in ``nearest``, otherwise the
    zone itself: a listed zone never uses its own value.
    """
    pairs = nearest.select(nearest_from, nearest_to)
    keyed = match(df, pairs, {zone: nearest_from}).withColumn("lookup_zone", F.coalesce(nearest_to, zone))
    found = match(keyed, zone_values, {**by, "lookup_zone": zone_column})
    return found.withColumn(name, F.coalesce(F.col(own), F.col(zone_value))).drop(nearest_to)


def per_scenario(df: DataFrame, scenarios: list[str], name: str = "scenario") -> DataFrame:
    """Every row once for each scenario of a parameter list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(s) for s in scenarios]).cast("array<string>")))


def range_lookup(
    df: DataFrame, value: str, ranges: DataFrame, low: str, high: str, how: str = "left", pieces: int = 16
) -> DataFrame:
    """Each row with the columns of every range that holds its value, both ends included.

    A null end is open; a range whose ends are crossed holds nothing; of overlapping ranges a value gets a row for each
    (choose before or after, for instance by the smallest key). A null or NaN value is in no range. ``how="left"`` keeps
    rows without a range, ``inner`` drops them.

    Ranges are cut into buckets of equal width, about ``pieces`` for a range of mean length; values beyond all ends share
    a bucket on either side. Rows and ranges meet by equality of the bucket, and the ends decide. The two outermost ends
    are read from the table of ranges when this is called.
    """
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    ends = F.array_compact(F.array(lo, hi))
    found = ranges.select(F.explode(ends).alias("e")).agg(F.min("e").alias("a"), F.max("e").alias("b")).first()
    mean = ranges.where(lo < hi).agg(F.avg(hi - lo).alias("m")).first().m
    first, width = found.a or 0.0, (mean or 1.0) / pieces
    last = int(((found.b or 0.0) - first) // width) + 1

    def bucket(v: Column) -> Column:
        inside = F.floor((v - first) / width).cast("double")
        return F.least(F.greatest(inside, F.lit(-1.0)), F.lit(float(last))).cast("long")

    start = F.when(lo.isNull(), F.lit(-1).cast("long")).otherwise(bucket(lo))
    stop = F.when(hi.isNull(), F.lit(last).cast("long")).otherwise(bucket(hi))
    valid = ranges.where(F.coalesce(lo <= hi, F.lit(True)) & ~F.coalesce(F.isnan(lo) | F.isnan(hi), F.lit(False)))
    cut = valid.withColumn("__bucket", F.explode(F.sequence(start, stop))).withColumnsRenamed({low: "__low", high: "__high"})
    v = F.col(value).cast("double")
    keyed = df.withColumn("__value_bucket", F.when(~F.isnan(v), bucket(v)))
    holds = (
        (F.col("__value_bucket") == F.col("__bucket"))
        & F.coalesce(v >= F.col("__low").cast("double"), F.lit(True))
        & F.coalesce(v <= F.col("__high").cast("double"), F.lit(True))
    )
    return keyed.join(cut, holds, how).withColumnsRenamed({"__low": low, "__high": high}).drop("__bucket", "__value_bucket")


def numbered_levels(df: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(_k, columns of all groups, _i): the distinct combinations of each group of columns, numbered from 0 within it.

    Combinations with a null are left out. One pass over the rows finds them all; a group's combinations are category
    levels and are numbered together.
    """
    types = {c: df.schema[c].dataType for g in groups for c in g}
    marks = [
        F.struct(F.lit(k).alias("_k"), *[(F.col(c) if c in g else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        for k, g in enumerate(groups)
    ]
    rows = df.select(F.explode(F.array(*marks)).alias("_m")).select("_m.*").distinct()
    whole = F.lit(False)
    for k, g in enumerate(groups):
        present = F.lit(True)
        for c in g:
            present = present & F.col(c).isNotNull()
        whole = whole | ((F.col("_k") == k) & present)
    order = Window.partitionBy("_k").orderBy(*types)
    return rows.where(whole).withColumn("_i", F.row_number().over(order) - 1)


def key_grid(
    df: DataFrame, keys: list[str], levels: dict[str, list] | None = None, keep: list[str] | None = None
) -> DataFrame:
    """All combinations of the distinct values of ``keys``, which are category columns.

    The levels of each key are numbered (or taken from ``levels``), and every number below the product of their counts
    is a combination, read as digits of mixed radix: the grid comes from a range that Spark splits as it likes, and each
    digit meets its level by equality. ``keep`` keys contribute their observed combinations instead of their product.
    Levels are counted when this is called.
    """
    spark, levels, keep = df.sparkSession, levels or {}, keep or []
    single = [k for k in keys if k not in keep]
    groups = ([keep] if keep else []) + [[k] for k in single if k not in levels]
    tables: list[tuple[list[str], DataFrame, int]] = []
    if groups:
        numbered = staged(numbered_levels(df, groups))
        sizes = {r["_k"]: r["n"] for r in numbered.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).collect()}
        tables += [(g, numbered.where(F.col("_k") == k).select(F.col("_i").cast("long").alias("_i"), *g), sizes.get(k, 0)) for k, g in enumerate(groups)]
    for k, values in levels.items():
        given = spark.createDataFrame([(i, v) for i, v in enumerate(values)], T.StructType().add("_i", "long").add(k, df.schema[k].dataType))
        tables.append(([k], given, len(values)))
    grid = spark.range(prod(n for _, _, n in tables))
    radix = 1
    for at, (_, _, n) in enumerate(tables):
        grid = grid.withColumn(f"_d{at}", F.floor(F.col("id") / radix) % max(1, n))
        radix *= max(1, n)
    for at, (_, values, _) in enumerate(tables):
        grid = grid.join(values.withColumnRenamed("_i", f"_d{at}"), f"_d{at}")
    return grid.select(*keys)


def densify(
    df: DataFrame,
    keys: list[str],
    fill: dict[str, float],
    levels: dict[str, list] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Full outer join against the key grid; absent or NaN measures named in ``fill`` take its value.

    ``keep`` names keys (usually the scenario) whose observed combinations are kept as they are and
    only crossed with the remaining keys. The rows are written to the shared folder once, and both the
    levels and the join read them there.
    """
    rows = staged(df)
    grid = key_grid(rows, keys, levels, keep)
    full = match(rows, grid, keys, "full")
    filled = {}
    for name, value in fill.items():
        c = F.col(name)
        if dict(df.dtypes)[name] in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        filled[name] = F.coalesce(c, F.lit(value))
    return full.withColumns(filled)
