"""Runs a query's SQL in DuckDB over an input folder and compares it with Spark's rows."""

from __future__ import annotations

import glob

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        files = glob.glob(f"{sf_dir}/{name}.parquet/*.parquet") or [f"{sf_dir}/{name}.parquet"]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
    return con


def same_rows(df, con, sql: str) -> None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    wanted = sorted(repr(tuple(str(r[i]) for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(str(x) for x in r)) for r in df.collect()) == wanted
