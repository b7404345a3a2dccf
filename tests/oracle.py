"""Compares a query with its SQL: same columns, same kinds of values, same rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def differences(spark_df, con, sql: str) -> str:
    """Empty if both sides agree."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {spark_df.columns} and {names}"
    cols = sorted(names)
    pick = [names.index(c) for c in cols]
    there = sorted((repr(tuple(_plain(r[i]) for i in pick)) for r in rel.fetchall()))
    here = sorted(repr(tuple(_plain(v) for v in r)) for r in spark_df.select(*[f"`{c}`" for c in cols]).collect())
    if here == there:
        return ""
    a, b = set(here), set(there)
    return f"{len(here)} rows here, {len(there)} there; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
