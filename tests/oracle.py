"""Runs a query and its SQL on the same tables and compares the rows."""

import math

import duckdb

SMALL = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return "~" if x is None else str(x)


def rows(cells):
    return sorted(tuple(map(_cell, r)) for r in cells)


def same(spark, connection, folder, fn, sql):
    df = fn(spark, folder)
    columns = sorted(df.columns)
    mine = rows(df.select(*columns).collect())
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = rows(connection.sql(f"select {names} from ({sql})").fetchall())
    assert mine == theirs
