"""Rows of a query held against those of SQL, as sorted text."""

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def said(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(said, v)) + "]"
    return str(v)


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def from_spark(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted("|".join(said(r[c]) for c in columns) for r in df.select(*columns).collect())


def from_sql(con, sql: str) -> tuple[list[str], list[str]]:
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    columns = sorted(own)
    return columns, sorted("|".join(said(r[own.index(c)]) for c in columns) for r in found.fetchall())
