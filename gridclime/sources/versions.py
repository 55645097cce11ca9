"""Tables whose every write is a version: staged first, then made current by one new manifest file.

``data/write=<id>`` holds what a write staged, ``manifest/<number>.json`` names the folders that make up a version. The
current version is the whole manifest of the highest number; readers look nowhere else, so they never see a staged write
that was not finished, and a version stays readable until ``vacuum`` removes it. A manifest is created only where none
of that number exists; a writer that finds another one's manifest decides anew on top of it. A manifest that does not
end is no version. The folders named are those that Spark lists to read the table: one per key value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..quality import CheckFailed, observed, require
from .folders import Folder


class KeyExistsError(ValueError):
    """The key is already in the table and overwriting was not asked for."""


def _manifest(folder: Folder, number: int) -> dict | None:
    try:
        return json.loads(folder.text(f"manifest/{number:08d}.json"))
    except ValueError:
        return None


def _numbers(folder: Folder) -> list[int]:
    names = [n.removesuffix(".json") for n in folder.names("manifest") if n.endswith(".json")]
    return [int(n) for n in names if n.isdigit()]


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that can be read, oldest first; none where there is no table."""
    folder = Folder(spark, path)
    return [n for n in _numbers(folder) if _manifest(folder, n)]


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the current one where none is given."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or ''} of a table in {path}")
    found = _manifest(Folder(spark, path), known[-1] if version is None else version)
    schema = T.StructType.fromJson(found["schema"])
    if not found["folders"]:
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("write", T.StringType())])
    reader = spark.read.schema(stored).option("basePath", f"{path}/data")
    return reader.parquet(*[f"{path}/data/{f}" for f in found["folders"]]).select(*schema.names)


def _stage(df: DataFrame, path: str, partition_by: list[str]) -> str:
    """Write below a folder that no version names yet."""
    if "write" in (c.lower() for c in df.columns):
        raise ValueError("a column of a table has another name than write")
    write = f"write={uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/data/{write}")
    return write


def _commit(spark: SparkSession, path: str, schema: T.StructType, folders: Callable[[list[str]], list[str]]) -> int:
    """Make ``folders(those of the current version)`` the next version."""
    folder = Folder(spark, path)
    while True:
        numbers = _numbers(folder)
        current = next((m for n in reversed(numbers) if (m := _manifest(folder, n))), None)
        named = folders(current["folders"] if current else [])
        number = max(numbers, default=0) + 1
        text = json.dumps({"schema": schema.jsonValue(), "folders": named})
        if folder.create(f"manifest/{number:08d}.json", text):
            return number


def rebuild_checked(
    df: DataFrame, path: str, partition_by: list[str] | None, metrics: dict[str, Column], expected: dict[str, object],
    without: list[str] | None = None,
) -> tuple[DataFrame, dict[str, object]]:
    """Replace the whole table, and count ``metrics`` in the job that writes it.

    Where one of them is not as ``expected``, CheckFailed is raised before the new version becomes current. Columns
    ``without`` are for metrics only and are not written.
    """
    spark = df.sparkSession
    watched, seen = observed(df, metrics, without)
    write = _stage(watched, path, partition_by or [])
    try:
        require(seen.get, expected)
    except CheckFailed:
        Folder(spark, path).delete(f"data/{write}")
        raise
    named = [write]
    if partition_by:
        named = [f"{write}/{n}" for n in Folder(spark, path).names(f"data/{write}") if "=" in n]
    _commit(spark, path, watched.schema, lambda _: named)
    return read_version(spark, path), seen.get


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the whole table; the former version stays and can be read by its number."""
    return rebuild_checked(df, path, partition_by, {"n_rows": F.count(F.lit(1))}, {})[0]


def write_keyed(df: DataFrame, path: str, key: str, overwrite: bool = False) -> DataFrame:
    """Insert rows by key, idempotently and all at once.

    Keys not in the table are inserted. If any of them is there already, its rows are replaced when ``overwrite`` is
    set, else KeyExistsError is raised and the table stays as it was. Other keys keep their rows. Which keys a write
    has is read from the folders it staged, so its rows are computed once. Until the manifest is there, readers see the
    former version; running a write again after a failure, or after its end, gives the same table.
    """
    spark = df.sparkSession
    write = _stage(df, path, [key])
    folder = Folder(spark, path)
    new = [n for n in folder.names(f"data/{write}") if n.startswith(f"{key}=")]

    def merged(current: list[str]) -> list[str]:
        held = {f.split("/", 1)[1]: f for f in current}
        if not overwrite and (clash := sorted(held.keys() & set(new))):
            folder.delete(f"data/{write}")
            raise KeyExistsError(f"{clash[0]} is already in {path}; use another one or overwrite")
        return sorted({**held, **{n: f"{write}/{n}" for n in new}}.values())

    order = [f for f in df.schema.fields if f.name != key] + [df.schema[key]]
    _commit(spark, path, T.StructType(order), merged)
    return read_version(spark, path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove versions but the last ``keep`` and the staged folders that none of them names; no write may be under way."""
    folder = Folder(spark, path)
    known = versions(spark, path)
    kept = known[-keep:]
    used = {f.split("/")[0] for n in kept for f in _manifest(folder, n)["folders"]}
    for n in _numbers(folder):
        if n not in kept and n < max(kept, default=0):
            folder.delete(f"manifest/{n:08d}.json")
    gone = [w for w in folder.names("data") if w.startswith("write=") and w not in used]
    for w in gone:
        folder.delete(f"data/{w}")
    return gone
