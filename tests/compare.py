"""Order-insensitive comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "-"
    if isinstance(x, bool) or isinstance(x, str):
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    try:
        return str(int(x)) if x == int(x) else repr(round(float(x), 6))
    except (TypeError, ValueError):
        return str(x)


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


def same(df, con, sql: str) -> tuple[int, str]:
    """(row count, "" or what differs)."""
    got = [tuple(r) for r in df.collect()]
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return len(got), f"columns {df.columns} and {want.columns}"
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    if a != b:
        return len(a), f"{len(a)} and {len(b)} rows; only in one: {sorted(set(a) ^ set(b))[:4]}"
    return len(a), ""
