"""Spark query and oracle side by side, as the driver compares them."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb

from siftline.session import TABLES


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, Decimal)):
        return repr(float(x))
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}" if x else "0.0"
    if isinstance(x, (list, tuple)):
        return f"[{','.join(map(plain, x))}]"
    if isinstance(x, dict):
        return f"{{{','.join(f'{plain(k)}:{plain(v)}' for k, v in sorted(x.items()))}}}"
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i] if not isinstance(r[i], float) or not r[i].is_integer() else int(r[i])) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())
