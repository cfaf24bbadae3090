"""Runs a query and its SQL side by side and compares rows without regard to their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    import os

    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}" if v else "0"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, db, sql):
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = db.sql(sql)
    want = table(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"{len(got[1])} and {len(want[1])} rows; only here {sorted(a - b)[:2]}, only in SQL {sorted(b - a)[:2]}"
    return ""
