"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents "
                 "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return ("\x00", "")
    if isinstance(v, decimal.Decimal):
        return ("n", round(float(v), 6))
    if isinstance(v, float):
        return ("n", round(v, 6))
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    return ("s", v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql):
    """Return (ok, message)."""
    scols = [f.name for f in spark_df.schema.fields]
    srows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    dcols, drows = rel.columns, rel.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns differ: {scols} vs {dcols}"
    a, b = canonical(scols, srows), canonical(dcols, drows)
    if a != b:
        return False, (f"{sum((a - b).values())} rows only in Spark, {sum((b - a).values())} only in "
                       f"DuckDB; e.g. {list((a - b).elements())[:2]} / {list((b - a).elements())[:2]}")
    return True, f"{len(srows)} rows"
