"""Runs a Spark query and its SQL on the same tables and compares rows regardless of order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def views(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else f'{p}/*.parquet'}'")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return float(f"{float(x):.9g}")
    return x


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, Counter(tuple(_cell(r[i]) for i in at) for r in cur.fetchall())


def differences(df, con, sql: str) -> str:
    (a, x), (b, y) = spark_rows(df), sql_rows(con, sql)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only Spark {list((x - y).items())[:3]}; only SQL {list((y - x).items())[:3]}"
    return ""
