"""Rows of a Spark query against DuckDB, in any order."""

import glob
import math
import os

import duckdb


def rows(columns, values):
    def show(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(show(r[k]) for k in order) for r in values)


def duck(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    return rows(found.columns, found.fetchall())


def same(df, sf_dir, sql):
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == duck(sf_dir, sql)
