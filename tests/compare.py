"""Rows of a query against rows of its SQL, in any order."""

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if math.isfinite(v) and v == int(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def ordered(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(df, con, sql):
    told = con.sql(sql)
    assert sorted(df.columns) == sorted(told.columns)
    assert ordered(df.collect(), df.columns) == ordered(told.fetchall(), told.columns)
