"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def rows_of(frame, columns):
    def cell(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, float) or type(x).__name__.startswith(("float", "Decimal")):
            return round(float(x), 6)
        if type(x).__name__ in ("bool", "bool_"):
            return bool(x)
        return x if isinstance(x, str) else int(x)

    return sorted((tuple(cell(x) for x in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def differences(df, sql: str, sf_dir: str) -> str:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want, got = con.execute(sql).df(), df.toPandas()
    if sorted(want.columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} instead of {sorted(want.columns)}"
    columns = sorted(want.columns)
    a, b = rows_of(got, columns), rows_of(want, columns)
    if a != b:
        return f"{len(a)} rows and {len(b)} in SQL; only here {sorted(set(map(repr, a)) - set(map(repr, b)))[:3]}, only there {sorted(set(map(repr, b)) - set(map(repr, a)))[:3]}"
    return ""
