"""Runs a query and its SQL on the same tables and says where they differ."""

from __future__ import annotations

import contextlib
import io
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p if p.is_file() else p / '*.parquet'}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def cell(x: object) -> str:
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return f"{float(x):.6f}".rstrip("0").rstrip(".")
        return str(x)

    return sorted(tuple(cell(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


def differences(spark, con, folder: str, query, sql: str) -> str:
    got = query(spark, folder)
    a, b = got.toPandas(), con.execute(sql).fetch_df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = canonical(a), canonical(b)
    if x == y:
        return ""
    only = [r for r in x if r not in set(y)][:3], [r for r in y if r not in set(x)][:3]
    return f"{len(x)} and {len(y)} rows; only here {only[0]}; only in SQL {only[1]}"


def plan(df) -> str:
    """The formatted physical plan."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
