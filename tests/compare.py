"""Compares a query with its SQL on the same tables, regardless of row order."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    out = [tuple(value(r[k]) for k in order) for r in data]
    return [columns[k] for k in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def check(query, sql: str, spark, sf_dir: str) -> str | None:
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), sql_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(bad)} of {len(a[1])} rows differ, first {bad[0]}" if bad else None
