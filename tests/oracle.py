"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.sql(sql)
    names = sorted(got.columns)
    places = [got.columns.index(c) for c in names]
    return names, sorted(([tuple(value(r[i]) for i in places) for r in got.fetchall()]), key=repr)


def rows_of_frame(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted([tuple(value(r[c]) for c in names) for r in frame.collect()], key=repr)
