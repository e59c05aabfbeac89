"""Rows of a query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows(df) -> list:
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in df.collect())


def sql_rows(sql: str, data: Path = DATA) -> tuple[list[str], list]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
