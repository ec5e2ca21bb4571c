"""Comparing a query with DuckDB SQL over the same files, without regard to order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _value(x):
    if isinstance(x, float):
        return ("f", "nan") if math.isnan(x) else ("f", round(x, 9))
    return (type(x).__name__.replace("Decimal", "int"), str(x))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def assert_same(spark, query, sql, sf_dir: str = DATA):
    df = query(spark, sf_dir)
    names, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(names, want)
