"""Compare a query with its SQL on DuckDB: columns, row count, values."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def connect(d):
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def same(df, sql, con):
    cols = sorted(df.columns)
    mine = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    theirs = sorted("|".join(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert sorted(names) == cols
    assert mine == theirs
