"""Rows of a query against rows of its SQL, as sorted text."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if v is None:
        return "NULL"
    if isinstance(v, (float, decimal.Decimal)):
        return "%.6g" % (float(v) or 0.0)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted("|".join(plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    result = con.sql(sql)
    names = sorted(result.columns)
    at = [result.columns.index(c) for c in names]
    return names, sorted("|".join(plain(r[i]) for i in at) for r in result.fetchall())
