"""Comparing a query with its SQL on DuckDB."""

import decimal
import math
from pathlib import Path

import duckdb


def views(data):
    c = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


def key(r):
    return tuple((x is None, str(x)) for x in r)


def agree(spark, data, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    cur = views(data).execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=key)
    assert ours == theirs
