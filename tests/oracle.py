"""Run a registered query and its SQL and compare them without order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}" if v else "0.000000"
    return str(v)


def _kind(dtype: str) -> str:
    d = dtype.lower()
    for prefix, kind in (("bigint", "bigint"), ("int", "int"), ("double", "double"),
                         ("varchar", "string"), ("string", "string"), ("bool", "boolean"),
                         ("timestamp", "timestamp")):
        if d.startswith(prefix):
            return kind
    return d


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> None:
    got_rows = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.sql(sql)
    want_types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    got_types = {c: _kind(t) for c, t in spark_df.dtypes}
    assert got_types == want_types, f"{got_types} != {want_types}"
    want_rows = rows_of(rel.columns, rel.fetchall())
    assert len(got_rows) == len(want_rows), f"{len(got_rows)} rows, want {len(want_rows)}"
    bad = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    assert not bad, f"{len(bad)} rows differ, first: {bad[0]}"
