"""Spark query against oracle SQL on the same parquet tables, as unordered rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def duck(root: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(root).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"create view {p.stem} as select * from read_parquet('{source}')")
    return c


def compare(spark, connection, query, sql: str, root: str) -> str:
    """'' when equal, else what differs."""
    df = query(spark, root)
    cols = sorted(df.columns)
    got = Counter(tuple(_cell(v) for v in r) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    cur = connection.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
