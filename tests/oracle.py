"""Side-by-side comparison of a query and its SQL."""

import glob
import os

import duckdb
import pandas as pd


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.5f}"
        if isinstance(x, pd.Timestamp):
            return str(x.tz_localize(None) if x.tzinfo is None else x.tz_convert("UTC").tz_localize(None))
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.5f}" if hasattr(x, "dtype") and x.dtype.kind in "iuf" or isinstance(x, int) else str(x)

    cols = sorted(df.columns)
    return sorted(tuple(one(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))
