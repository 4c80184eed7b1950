"""Compare a query with its SQL on the same tables, as sorted rows."""

import datetime
import math
from pathlib import Path

import duckdb


def connection(sf_dir):
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return ("f", "nan")
        return ("n", f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return ("s", str(value))


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    got = [d[0] for d in cursor.description]
    names = sorted(got)
    at = [got.index(n) for n in names]
    return names, sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())
