"""Run registered queries beside their SQL and compare rows, as multisets."""

import math
import os
from collections import Counter

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{name}{'/*.parquet' if os.path.isdir(f'{sf_dir}/{name}') else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "is_finite"):
        return float(f"{float(v):.9g}")
    return v


def differences(con, df, sql):
    """An empty string, or what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in want_rows)
    got = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if want == got:
        return ""
    less, more = list((want - got).items())[:3], list((got - want).items())[:3]
    return f"{sum(got.values())} and {sum(want.values())} rows; missing {less}; extra {more}"
