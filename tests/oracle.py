"""Comparison of a registered query with its SQL, on whole tables."""

import datetime
import glob
import math
import os

import duckdb

DATA = os.environ.get("LUMENFRAME_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return v


def compare(spark, query, sql, data=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = sorted((tuple(plain(v) for v in row) for row in result.fetchall()), key=repr)
    df = query(spark, data)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == want
