"""WARC archives: one gzip member a record, written by tasks and read back by tasks that own byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Tables, tasks_for

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task reads.
SPLIT = 16 << 20
READ = 1 << 20
#: What stands for a null id.
NO_ID = "none"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)
    return fs.FileSystem.from_uri(uri)


def decide(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """(id, sha1, refers_to) of the rows that revisit the largest id among those of an equal payload."""
    keys = pages.select(F.col(id_col).alias("id"), F.sha1(payload_col).alias("sha1"), F.octet_length(payload_col).alias("n"))
    keys = keys.where(F.col("n") >= least).select("id", "sha1")
    heads = keys.groupBy("sha1").agg(F.max("id").alias("refers_to"), F.count("*").alias("m")).where("m > 1").drop("m")
    return keys.join(heads, "sha1").where("id < refers_to").distinct()


def record(page: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with one record; a revisit has no block but tells digest and length of what it stands for."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{NO_ID if page is None else page}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', ' ', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0
) -> DataFrame:
    """Write a record for each row below ``folder`` and return (path, bytes) of the archives.

    A null payload is empty; a row with a null id is a response of its own. Of equal payloads of at least ``least`` bytes the largest id is the response. Rows with
    one id and payload are records of one kind. Each task writes a file of its own under a name of its attempt and
    gives it its final name when it is complete, so that a task that runs again replaces its file.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    again = decide(rows, "id", "payload", least)
    rows = rows.withColumn("sha1", F.sha1("payload")).join(again, ["id", "sha1"], "left").select("id", "url", "payload", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        final, own = f"{root}/part-{task:06d}.warc.gz", f"{root}/_{task}-{uuid.uuid4().hex}"
        n = 0
        with system.open_output_stream(own, compression=None) as out:
            for b in chain([first], batches):
                n += _put(out, b)
        system.move(own, final)
        yield pa.RecordBatch.from_pydict({"path": [final], "bytes": [n]})

    def _put(out, b: pa.RecordBatch) -> int:
        n = 0
        for page, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns)):
            data = record(page, url, payload, refers_to)
            out.write(data)
            n += len(data)
        return n

    return rows.mapInArrow(write, "path string, bytes long")


def read_archives(spark: SparkSession, folder: str, files: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of archives. files: (path, bytes) as ``write_archives`` returns them.

    Each file is cut into byte ranges. A task looks for the gzip magic in its range, takes a place for a member if the
    bytes from there decode to a WARC header, and owns the records that start inside, also if they end beyond.
    """
    ranges = files.select(
        "path", "bytes", F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L), {split}L)")).alias("start")
    )
    # rows of a few bytes that open into whole archives: a count of their own, which Spark does not merge
    ranges = ranges.repartition(tasks_for(spark, ranges.count()), "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(folder)
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with system.open_input_file(path) as f:
                    rows = []
                    for r in members(f, start, min(start + split, size)):
                        rows.append(parse(r))
                        if len(rows) == 200:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    return ranges.mapInArrow(read, "id long, type string, refers_to long, url string, digest string, length long, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 7
    names = ["id", "type", "refers_to", "url", "digest", "length", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def members(f, start: int, end: int) -> Iterator[bytes]:
    """Decoded members that begin in start..end of an open file."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(READ, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        if at >= end:
            return
        data, used = member(f, at)
        if data is None:
            at += 1
        else:
            yield data
            at += used


def member(f, at: int) -> tuple[bytes | None, int]:
    """(bytes, length) of the gzip member at a place of the file; None if it is none, or has no WARC header."""
    z = zlib.decompressobj(31)
    out, used = [], 0
    step = 4096
    f.seek(at)
    while not z.eof:
        data = f.read(step)
        step = READ
        if not data:
            return None, 0
        try:
            out.append(z.decompress(data))
        except zlib.error:
            return None, 0
        used += len(data) - len(z.unused_data)
        head = out[0] if len(out) == 1 else b"".join(out)[:16]
        if len(head) >= 7 and not head.startswith(b"WARC/1."):
            return None, 0
    whole = b"".join(out)
    return (whole, used) if whole.startswith(b"WARC/1.") else (None, 0)


def parse(data: bytes) -> tuple:
    """(id, type, refers to, url, digest, payload length, payload) of a record; digest and length of a response are made anew."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda x: None if (n := x[len("<urn:page:") : -1]) == NO_ID else int(n)
    body = body[: int(fields["Content-Length"])]
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response":
        digest, length = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(fields["WARC-Record-ID"]), fields["WARC-Type"], refers, fields["WARC-Target-URI"], digest, length, body


def round_trip(pages: DataFrame, split: int = SPLIT, **columns) -> DataFrame:
    """Write pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    tables = Tables(spark, "warc")
    files = tables.save(write_archives(pages, f"{tables.root}/archives", **columns), "files")
    return read_archives(spark, f"{tables.root}/archives", files, split)
