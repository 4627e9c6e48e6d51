"""Runs a query and its SQL, and compares rows without order."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("SPANMILL_DATA", "/root/testdata/sf0.001")


def oracle(sql, views=None):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def value(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal):
        return "None" if v != v else f"{float(v) + 0.0:.6g}"
    if isinstance(v, int):
        return f"{v:.6g}" if abs(v) < 100000 else str(v)
    return str(v)


def same(df, sql):
    names, want = oracle(sql)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(value(r[i]) for i in at) for r in want)
