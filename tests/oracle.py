"""Compares a query with its SQL over the same tables."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, query, sql, sf_dir):
    """None if both agree, else what differs."""
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    b = rows([c[0] for c in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        only = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
        return f"{len(a[1])} and {len(b[1])} rows, {only}"
    return None
