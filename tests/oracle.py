"""Compares a query with its DuckDB twin as bags of rows, columns by name."""

import datetime
import decimal
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def bag(names, rows):
    at = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in at], sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def both(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    return mine, bag([d[0] for d in cur.description], cur.fetchall())
