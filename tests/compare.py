"""Rows of a query against its SQL twin in DuckDB."""

from __future__ import annotations

import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    return v


def same(df, con, sql: str) -> None:
    rows, cols = df.collect(), sorted(df.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    got = Counter(tuple(plain(r[c]) for c in cols) for r in rows)
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])
