"""Hold a DataFrame against DuckDB over the same parquet files."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float | Decimal) or type(v).__name__.startswith("float"):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def same(df, sql, sf_dir):
    got, want = rows(df.toPandas()), rows(views(sf_dir).execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


