"""Compares a query's rows with those of its SQL in DuckDB, columns by name and in any order of rows."""

from __future__ import annotations

import datetime
import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(table) -> Counter:
    names = sorted(table.column_names)
    columns = [[_plain(x) for x in table.column(c).to_pylist()] for c in names]
    return Counter(map(str, zip(*columns, strict=True)))


def differences(df, con, sql: str) -> list[str]:
    """Nothing where both agree."""
    ours, theirs = df.toArrow(), con.sql(sql).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return [f"columns {sorted(ours.column_names)} and {sorted(theirs.column_names)}"]
    a, b = rows_of(ours), rows_of(theirs)
    out = [f"only ours: {x}" for x in list((a - b).keys())[:3]] + [f"only SQL: {x}" for x in list((b - a).keys())[:3]]
    return [f"{sum(a.values())} and {sum(b.values())} rows", *out] if out else []
