"""Writers. Inputs are never overwritten; derived tables are rebuilt or replaced by key, see ``versions``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folders import Folder
from .versions import KeyExistsError, read_version, rebuild, rebuild_checked, vacuum, versions, write_keyed

__all__ = [
    "KeyExistsError", "export_by_scenario", "materialise", "read_version", "rebuild", "rebuild_checked", "vacuum", "versions", "write_csv",
    "write_files", "write_keyed", "write_new", "write_outputs",
]


def materialise(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write a derived table (rebuilt by default, or appended to) and return it read back."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_new(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write adjusted inputs to a path that does not exist yet, leaving the originals as they are."""
    return materialise(df, path, partition_by, mode="errorifexists")


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Headered CSV, one directory per value of the partition columns."""
    writer = df.write.mode(mode).option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def export_by_scenario(demand: DataFrame, path: str, key: str = "demand_scenario_id") -> None:
    """One CSV directory per demand scenario, all written by one job."""
    write_csv(demand, path, [key])


def write_outputs(outputs: dict[str, DataFrame], root: str, format: str = "parquet") -> None:
    """Named result tables below one directory."""
    for name, df in outputs.items():
        df.write.mode("overwrite").option("header", True).format(format).save(f"{root}/{name}")


def write_files(lines: DataFrame, root: str, file: str = "file", order: str = "number", line: str = "line") -> None:
    """One text file below ``root`` for each value of ``file`` (a path), its lines in ``order``.

    A file is written by one task; files are given their names when all are written.
    """
    spark = lines.sparkSession
    named = lines.select(F.xxhash64(file).alias("_file"), order, F.col(line).cast("string").alias("value"), file)
    staging = f"staging-{uuid.uuid4().hex}"
    named.repartition("_file").sortWithinPartitions("_file", order).select("_file", "value").write.partitionBy("_file").text(
        f"{root}/{staging}"
    )
    folder = Folder(spark, root)
    for r in named.select("_file", file).distinct().toLocalIterator():
        parts = [n for n in folder.names(f"{staging}/_file={r[0]}") if n.startswith("part-")]
        if len(parts) != 1:
            raise ValueError(f"{r[1]} and another file have the same hash")
        folder.move(f"{staging}/_file={r[0]}/{parts[0]}", r[1])
    folder.delete(staging)
