"""Comparison of a registered query with its DuckDB SQL."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def database():
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return db


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def same_rows(spark, query, sql):
    """Whether both give the same rows, whatever the order of rows and columns; the query's plan for more checks."""
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    found = database().execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall()), key=str)
    assert got == want
    return df._jdf.queryExecution().executedPlan().toString()
