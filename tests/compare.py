"""Rows of a query against rows of its SQL, without regard to order."""

import glob
import math
import os

import duckdb


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>"):
        return "null"
    if type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    try:
        f = float(x)
    except (TypeError, ValueError):
        return str(x)
    return f"{f:.7g}" if not isinstance(x, str) else x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con
