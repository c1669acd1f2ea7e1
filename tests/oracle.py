"""Compare a Spark result with DuckDB SQL over the same tables, as sorted text."""

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fmt = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(fmt(r[i]) for i in order) for r in data)


def agree(spark, sf, query, sql):
    df = query(spark, sf)
    rel = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs, strict=True):
        assert a == b
    return len(mine)
