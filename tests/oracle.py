"""Runs a query and its SQL over the same tables and compares the rows."""

import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(df):
    return sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(df.columns)).collect()), key=lambda r: [(v is None, str(v)) for v in r])


def expected(sql, sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=lambda r: [(v is None, str(v)) for v in r])


def agrees(df, sql, sf_dir):
    names, want = expected(sql, sf_dir)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
