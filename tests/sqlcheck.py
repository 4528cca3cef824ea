"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def _cell(x):
    if x is None or x != x:
        return "~"
    if hasattr(x, "tolist"):
        x = x.tolist()
    return f"{x:.6g}" if isinstance(x, float) and not math.isinf(x) else str(x)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(_cell(r[i]) for i in order) for r in data)


def connection():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def check(spark, query, sql):
    df = query(spark, DATA)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = connection().sql(sql)
    assert got == rows(r.columns, r.fetchall())
