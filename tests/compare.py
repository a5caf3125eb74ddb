"""Comparing a Spark result with DuckDB's on the same tables."""

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return str(v) if v is not None and not isinstance(v, str | bool | list) else v


def rows(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object)
    return sorted((tuple(_cell(v) for v in r) for r in plain.where(plain.notna(), None).itertuples(index=False)), key=repr)
