"""Side by side with DuckDB, as bags of rows."""

import math
import os
from datetime import datetime

import duckdb

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(sql, data=DATA):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
