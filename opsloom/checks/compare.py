"""Compare a registered query with its SQL on the same parquet files (needs duckdb; tests only)."""
from __future__ import annotations

import datetime as dt
import decimal
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """Return (ok, message, spark seconds, sql seconds)."""
    t0 = time.time()
    df = fn(spark, folder)
    if len({c.lower() for c in df.columns}) < len(df.columns):
        return False, f"repeated columns {df.columns}", 0.0, 0.0
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return bool(got[1]), f"rows={len(got[1])} (no SQL)", t1 - t0, 0.0
    cur = con.execute(sql)
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if got[1] != want[1]:
        a, b = set(map(repr, got[1])), set(map(repr, want[1]))
        msg = (f"rows {len(got[1])} vs {len(want[1])}\n   only spark: {sorted(a - b)[:3]}"
               f"\n   only sql:   {sorted(b - a)[:3]}\n   columns {got[0]}")
        return False, msg, t1 - t0, t2 - t1
    return bool(got[1]), f"rows={len(got[1])}", t1 - t0, t2 - t1
