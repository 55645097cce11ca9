"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # no broadcast() hints anywhere: a side is broadcast only when Spark has measured it below this
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(app: str = "gridclime", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or one in the warehouse where none is named: both are shared by executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a new folder beside the cluster's shared checkpoints."""
    return f"{shared_folder(spark)}/gridclime-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: it runs once, and Spark knows its size when it plans a join."""
    path = scratch(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
