"""Results of Spark and DuckDB side by side."""

import glob
import os

import duckdb


def connect(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) and v == v else repr(v)


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    cursor = connect(sf).execute(sql)
    heads = [x[0] for x in cursor.description]
    assert sorted(heads) == names
    want = sorted(tuple(plain(dict(zip(heads, r))[n]) for n in names) for r in cursor.fetchall())
    return got, want
