"""A Spark result held against DuckDB SQL over the same files, row by row."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__module__ in ("decimal", "numpy"):
        return f"{float(x):.6f}".replace("-0.000000", "0.000000")
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def same(query, sql: str, spark, sf_dir: str) -> None:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    got = query(spark, sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())
