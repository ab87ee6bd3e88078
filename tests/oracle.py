"""Compares a query with its DuckDB SQL."""

from __future__ import annotations

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


def compare(spark, sf_dir: str, query, sql: str) -> None:
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    names = ",".join(f'"{x}"' for x in columns)
    want = c.sql(f"SELECT {names} FROM ({sql})")
    assert sorted(c.sql(sql).columns) == columns
    assert Counter(tuple(plain(x) for x in r) for r in df.select(*columns).collect()) == Counter(tuple(plain(x) for x in r) for r in want.fetchall())
