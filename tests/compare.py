"""Run registered queries against their DuckDB oracles."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from leadflow.plans.inputs import BASE_TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(float(f"{value:.9g}"))
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value if value is None else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r]
    )


def difference(df, con, sql: str) -> str | None:
    """None when both agree, else a short text."""
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other = normal([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} against {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"{len(mine[1])} rows against {len(other[1])}"
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return f"{a} against {b}"
    return None
