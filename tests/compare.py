"""Rows of a query and of its SQL in one comparable form."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _value(x):
    if isinstance(x, decimal.Decimal):
        x = int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float) and x == int(x) and abs(x) < 2**53:
        return int(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(_value(r[i])) for i in order) for r in rows)


def check(spark, queries, sql, name, sf_dir):
    made = queries[name](spark, sf_dir)
    found = database(sf_dir).sql(sql[name])
    assert sorted(made.columns) == sorted(found.columns)
    mine, theirs = rows_of(made.columns, made.collect()), rows_of(found.columns, found.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
