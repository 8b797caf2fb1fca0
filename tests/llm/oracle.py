"""Runs an operator's SQL on the test tables."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def run(sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), sorted(tuple(x for _, x in sorted(zip(names, r, strict=True))) for r in cur.fetchall())


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(r[n] for n in names) for r in df.collect())
