"""Runs a query in Spark and its SQL twin in DuckDB and compares the rows."""

import os

import duckdb
import pandas as pd


def rows(frame: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, (list, dict)) and pd.isna(x)):
            return ""
        return str(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    names = sorted(frame.columns)
    return sorted(tuple(cell(x) for x in r) for r in frame[names].itertuples(index=False))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def assert_same(spark, query, sql: str, sf_dir: str) -> None:
    ours, theirs = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
