"""Holds a query's rows against its SQL run by DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return repr(v)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def check(df, con, sql):
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    expected = sorted(tuple(norm(v) for v in row) for row in found.select(*[f'"{c}"' for c in columns]).fetchall())
    got = sorted(tuple(norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == expected
