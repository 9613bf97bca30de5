"""Runs a query and its SQL on the same tables and compares their rows."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in values)


def assert_same(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    found = con.sql(sql)
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())
