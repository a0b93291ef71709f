"""Compare a query with its SQL in DuckDB, as sets of rows."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{v:.9g}" if isinstance(v, float) else f"{float(v):.9g}" if abs(v) < 1 << 53 else str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sql, views=None):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    for name, frame in (views or {}).items():
        con.register(f"_{name}", frame)
        con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM _{name}")
    got = con.sql(sql)
    return got.columns, got.fetchall()


def check(query, sql, spark, sf_dir=DATA):
    df = query(spark, sf_dir)
    columns, rows = duck(sql)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)
