"""Spark rows against DuckDB rows."""

import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(records):
    def plain(v):
        return round(v, 3) + 0.0 if isinstance(v, float) else str(v)

    return sorted([[None if v is None or v != v else plain(v) for v in r] for r in records], key=str)


def same(df, sql, connection):
    found = connection.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    ours = rows([[r[n] for n in names] for r in df.collect()])
    theirs = rows([[dict(zip(found.columns, r))[n] for n in names] for r in found.fetchall()])
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= 2e-3 * max(1.0, abs(x)), (a, b)
            else:
                assert x == y, (a, b)
