"""Compare a query with its SQL in DuckDB, rows as a bag."""

import glob
import math
import os

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def connect(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def assert_same(df, sql, sf_dir=None, con=None):
    cur = (con or connect(sf_dir)).execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    want = sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    got = sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())
    assert got == want
