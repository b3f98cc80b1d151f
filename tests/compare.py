"""Rows of a Spark result and of DuckDB, made comparable."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    try:
        return f"{float(v):.9g}" if type(v).__module__ == "decimal" else str(v)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def assert_same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, r.fetchall())
