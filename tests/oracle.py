"""A query's rows against DuckDB's for its SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(pdf) -> list[tuple]:
    """The rows in one order, with numbers to six digits and everything missing as None."""
    missing = lambda v: pd.api.types.is_scalar(v) and pd.isna(v)
    shown = lambda v: "None" if missing(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(v) for v in row) for row in pdf[sorted(pdf.columns)].itertuples(index=False))


def check(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), tables(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
