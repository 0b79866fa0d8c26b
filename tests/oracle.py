"""Compare a query's rows with its SQL in DuckDB, without regard to order."""

import glob
import math
import os

import duckdb
import pandas as pd


def connection(directory: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(_value, v)) if isinstance(v, list) else v


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)
