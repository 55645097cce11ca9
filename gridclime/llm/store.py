"""Intermediate tables and small fixed-size summaries that survive the loss of an executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts are long rows: so many of them at a time bound what a task and its Python worker hold of them.
ROWS_A_BATCH = 1000


class Tables:
    """Parquet tables below one new folder of the shared folder; each ends the lineage of what made it.

    Where the session has Spark's own number of rows in an Arrow batch, it is lowered to ROWS_A_BATCH.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        if spark.conf.get(ARROW_BATCH) == "10000":
            spark.conf.set(ARROW_BATCH, ROWS_A_BATCH)
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def save_parts(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Tables of one schema, one at least, as one table; each is written before the next is made."""
        for df in parts:
            df.write.mode("append").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table of this folder that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks_for(spark: SparkSession, pieces: int) -> int:
    """Tasks for so many pieces of work: one each, up to four for every core."""
    return max(1, min(pieces, 4 * spark.sparkContext.defaultParallelism))


def bit_filter(keys: DataFrame, key: str, bits: int = 1 << 23) -> np.ndarray:
    """A bit for each (key mod bits) among the 64-bit hashes ``key``, packed; bits/8 bytes whatever the number of keys.

    Use ``in_filter`` for the test. A key of the table always passes, so a join after it stays exact.
    """
    block = 1 << 16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = []
            for slots in b.column(1).to_pylist():
                flags = np.zeros(block, np.uint8)
                flags[slots] = 1
                blobs.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], ["block", "bits"])

    rows = (
        keys.select(F.pmod(F.col(key), F.lit(bits)).alias("slot"))
        .distinct()
        .groupBy((F.col("slot") / block).cast("long").alias("block"))
        .agg(F.collect_list((F.col("slot") % block).cast("int")).alias("slots"))
        .mapInArrow(pack, "block long, bits binary")
        .collect()
    )
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r.block * block // 8 : (r.block + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def in_filter(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which signed 64-bit keys may be in the filter."""
    slot = keys.astype(np.int64) % (len(filter_bits) * 8)
    return (filter_bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
