"""Runs a registered query and its SQL on the same files and compares all rows."""

from __future__ import annotations

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def same(spark, con, data: str, query, sql: str) -> None:
    got = query(spark, data)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted((tuple(_plain(v) for v in r) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(_plain(r[n]) for n in names) for r in got.collect()), key=str) == want
