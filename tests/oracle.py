"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("BRAIDWORK_DATA", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(_plain(y) for y in x.values())
    if hasattr(x, "asDict"):
        return tuple(_plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if hasattr(x, "is_finite"):
        return round(float(x), 6)
    return x


def rows_of_sql(sql: str, data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, query, sql: str, data: str = DATA) -> int:
    """Assert equal rows, in any order; returns their number."""
    df = query(spark, data)
    names, want = rows_of_sql(sql, data)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    expected = sorted((tuple(_plain(r[i]) for i in at) for r in want), key=repr)
    assert len(got) == len(expected), (len(got), len(expected))
    for g, e in zip(got, expected):
        assert g == e, f"{g}\n!=\n{e}"
    return len(got)
