"""Data-quality profiles (the generator's validation step, as queries):
B1 null profile, B3 date ranges, B4 quantity reconciliation.

Each profile is a single aggregation pass per table (all columns' null
counts in one ``agg``), unpivoted afterwards on the 1-row result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, table: str) -> DataFrame:
    """B1: (table_name, column_name, null_count, row_count) for every column.
    COUNTs of plain columns only, which Parquet footers can answer."""
    cols = df.columns
    counts = df.agg(
        F.count(F.lit(1)).cast("bigint").alias("_rows"),
        *[F.count(F.col(c)).cast("bigint").alias(f"_n{i}") for i, c in enumerate(cols)],
    )
    long = counts.unpivot(
        ids=["_rows"],
        values=[f"_n{i}" for i in range(len(cols))],
        variableColumnName="_col",
        valueColumnName="_filled",
    )
    name = F.element_at(F.array(*[F.lit(c) for c in cols]),
                        F.regexp_extract("_col", r"_n(\d+)", 1).cast("int") + 1)
    return long.select(
        F.lit(table).alias("table_name"), name.alias("column_name"),
        (F.col("_rows") - F.col("_filled")).alias("null_count"), F.col("_rows").alias("row_count"),
    )


def null_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [null_profile(df, t) for t, df in tables.items()])


def date_range_profile(purchases: DataFrame, sales: DataFrame) -> DataFrame:
    """(field, min_date, max_date) for purchase, expiry and sale dates:
    one aggregate per table, turned into rows by ``inline``."""
    p = purchases.agg(
        F.min("purchase_date").alias("a0"), F.max("purchase_date").alias("b0"),
        F.min("expiry_date").alias("a1"), F.max("expiry_date").alias("b1"),
    )
    s = sales.agg(F.min("sale_date").alias("a2"), F.max("sale_date").alias("b2"))

    def row(field: str, lo: str, hi: str):
        return F.struct(F.lit(field).alias("field"), F.col(lo).alias("min_date"),
                        F.col(hi).alias("max_date"))

    return p.crossJoin(F.broadcast(s)).select(F.inline(F.array(
        row("purchase_date", "a0", "b0"), row("expiry_date", "a1", "b1"), row("sale_date", "a2", "b2"),
    )))


def quantity_reconciliation(purchases: DataFrame) -> DataFrame:
    """Purchased vs remaining units, implied sold units, and the number of
    batches whose remaining quantity exceeds the purchased quantity."""
    qp, q = F.col("quantity_purchased"), F.col("quantity_remaining")
    g = purchases.agg(
        F.coalesce(F.sum(qp), F.lit(0)).cast("bigint").alias("total_purchased"),
        F.coalesce(F.sum(q), F.lit(0)).cast("bigint").alias("total_remaining"),
        F.count(F.when(q > qp, 1)).cast("bigint").alias("batches_remaining_above_purchased"),
    )
    return g.select(
        "total_purchased", "total_remaining",
        (F.col("total_purchased") - F.col("total_remaining")).alias("approx_sold"),
        "batches_remaining_above_purchased",
    )


def preview(df: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by ``keys``, the other columns breaking ties, so
    that every run shows the same rows (a per-task top n, then a merge)."""
    rest = [c for c in df.columns if c not in keys]
    return df.orderBy(*keys, *rest).limit(n)


def type_report(df: DataFrame, table: str) -> list[tuple[str, str, str]]:
    """B2: (table, column, type) from the declared schema - metadata only,
    no job runs."""
    return [(table, f.name, f.dataType.simpleString()) for f in df.schema.fields]
