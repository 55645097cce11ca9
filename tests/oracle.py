"""Compare a Spark result with its SQL on the same Parquet files, value by value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_normal(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, row count, value types and values all agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    got = _rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if len(got) != len(expected):
        return [f"{len(got)} rows != {len(expected)} rows"]
    if not got:
        return ["no rows"]
    bad = [(g, e) for g, e in zip(got, expected) if repr(g) != repr(e)]
    return [f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}"] if bad else []
