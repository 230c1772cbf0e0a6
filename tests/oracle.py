"""Run a query's SQL in DuckDB over the driver tables and compare rows, whatever their order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(text(r[k]) for k in order) for r in rows)


def sql_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    out = con.sql(sql)
    return rows_of(out.columns, out.fetchall())


def assert_equal(df, sql, folder):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = sql_rows(sql, folder)
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
