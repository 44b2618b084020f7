"""Run a registered query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def close(a, b, tol=1e-9):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y, tol) for x, y in zip(a, b))
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def connect(sf):
    con = duckdb.connect()
    for f in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def sortable(row):
    return tuple((x is None, str(type(x)), -1.0 if x is None else x) if not isinstance(x, tuple) else (False, "t", str(x)) for x in row)


def compare(spark, sf, fn, sql, con):
    """None when equal, else a message."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in idx) for r in raw]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(key=sortable)
    want.sort(key=sortable)
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    if bad:
        exact = len(bad)
        return f"{exact} of {len(got)} rows differ; cols {cols}; first {bad[0]}"
    return None
