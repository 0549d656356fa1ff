"""Compares a registered query with its DuckDB SQL on the tables of a folder."""

import glob
import math
import os
from collections import Counter

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def compare(spark, name, sf_dir, queries, oracle):
    df = queries[name](spark, sf_dir)
    rel = tables(sf_dir).sql(oracle[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns), (cols, sorted(rel.columns))
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
    assert not missing and not extra, f"{name}: columns {cols}\nonly in SQL {missing}\nonly in Spark {extra}"
    return sum(got.values())
