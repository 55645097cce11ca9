"""Lines of splittable text files: their numbers, and the first lines of each file.

A large file is read by many tasks. What a line means often depends on its place (a preamble, a header, a calendar that
goes by position), so each byte range counts its lines first; ranges get the sum of the ranges before them, and the reading
adds that to the place inside the range. First lines come from a probe that stops as soon as it has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import staged

#: Files in one task of the probe never share it with another file when opening one is said to cost this much.
APART = 1 << 40


def decoded_path(path: Column | None = None) -> Column:
    """Path of the source file with %xx escapes resolved."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def path_part(path: Column, from_end: int) -> Column:
    """Path component counted from the end; 1 is the file name."""
    return F.element_at(F.split(path, "/"), -from_end)


def is_blank(line: Column) -> Column:
    return F.trim(line) == ""


def first_lines(spark: SparkSession, glob: str | list[str], n: int) -> DataFrame:
    """(file, head) with the first n lines of each file, fewer in a shorter file; files without a line have no row.

    Each byte range is a task of its own that ends with its first batch of lines, or at once where it does not begin
    its file, so only the start of a file is read. Files go through Spark's own reader, whatever their file system.
    """
    probe = spark.newSession()
    probe.conf.set("spark.sql.files.openCostInBytes", APART)
    rows = probe.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, file = [], None
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py():
                return
            if batch.num_rows:
                file = batch.column(0)[0].as_py()
                head += batch.column(2).slice(0, n - len(head)).to_pylist()
            if len(head) >= n:
                break
        if head:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([head], pa.list_(pa.string()))], ["file", "head"])

    return staged(rows.mapInArrow(take, "file string, head array<string>"))


def file_lines(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """(file, start, value) of the lines that are not blank, from one scan; start is the first byte of their range."""
    rows = spark.read.text(glob).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    return rows.where(~is_blank(F.col("value")))


def numbered_lines(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """(file, number, n_lines, value) of the lines that are not blank, numbered from 1 in each file.

    The ranges' counts are taken when this is called, by a scan that keeps one row per range. Both scans cut the files
    alike, and ids rise by one inside a range. Where files or settings have changed since, reading fails rather than
    numbering lines wrongly.
    """

    def scan() -> DataFrame:
        return file_lines(spark, glob).withColumn("_id", F.monotonically_increasing_id())

    ranges = scan().groupBy("file", "start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(
        ranges.select(
            "file", "start", "_n", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_n").over(Window.partitionBy("file")).alias("n_lines"),
        )
    )
    inside = F.col("_id") - F.col("_first")
    number = F.when(inside.between(0, F.col("_n") - 1), F.col("_before") + inside + 1).otherwise(
        F.raise_error(F.lit("the files were cut otherwise when their lines were counted")).cast("long")
    )
    placed = scan().join(offsets, ["file", "start"], "left")
    return placed.select("file", number.alias("number"), "n_lines", "value")


def cells(line: Column, sep: str = ",") -> Column:
    """Cells of a line; separators inside double quotes do not split, a doubled quote inside them is one."""
    quoted, end = ' *"[^"]*+(?:""[^"]*+)*+" *', re.escape(sep)
    found = F.regexp_extract_all(F.concat(line, F.lit(sep)), F.lit(f"{quoted}{end}|[^{end}]*+{end}"), F.lit(0))
    whole = F.transform(found, lambda c: F.substr(c, F.lit(1), F.length(c) - len(sep)))
    bare = lambda c: F.replace(F.regexp_replace(c, '^ *"|" *$', ""), F.lit('""'), F.lit('"'))
    read = F.transform(whole, lambda c: F.when(c.rlike(f"^{quoted}$"), bare(c)).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), read).otherwise(F.split(line, end))


def trimmed(values: Column) -> Column:
    return F.transform(values, lambda c: F.trim(c))
