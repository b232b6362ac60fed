"""Comparison of a Spark result with DuckDB's, whatever the order of rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        v = round(v, 5) + 0.0
        return int(v) if v == int(v) else v
    return v


def rows(frame: pd.DataFrame) -> list:
    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)
