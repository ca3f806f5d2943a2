"""Typed readers and writers for the domain tables.

Sources: CSV in the dialect of the shipped exports (header, comma,
``dd-MM-yyyy`` dates, no quoting) and Parquet. Schemas are always declared;
inference would read those dates as strings and prices as doubles.

Sinks: Parquet (default, partitioned when a column is given) and CSV with a
header for spreadsheet exports.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.checks import MissingInputError, require_columns
from shelfwise.sources.schemas import TABLE_SCHEMAS, USED_COLUMNS

CSV_DATE_FORMAT = "dd-MM-yyyy"


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one domain table from CSV in the shipped dialect (FAILFAST). The
    header must name the declared columns in their order."""
    return (
        spark.read.schema(TABLE_SCHEMAS[table])
        .option("header", True)
        .option("enforceSchema", False)
        .option("dateFormat", CSV_DATE_FORMAT)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one domain table from Parquet, cast to the declared schema.

    A column that some query reads must be there; the other declared columns
    come back as typed NULLs where the files lack them.
    """
    df = spark.read.parquet(path)
    require_columns(df, table, USED_COLUMNS[table])
    present = set(df.columns)
    return df.select(
        [
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLE_SCHEMAS[table].fields
        ]
    )


class LazyTables(Mapping):
    """Tables opened on first use, so a report that does not need a table
    runs even when its files are absent (the reference ships no sales file);
    a query that does need it fails with ``MissingInputError``."""

    def __init__(self, openers: dict[str, Callable[[], DataFrame]]):
        self._openers = openers
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            try:
                self._open[name] = self._openers[name]()
            except AnalysisException as exc:
                raise MissingInputError(f"{name}: {exc}") from exc
        return self._open[name]

    def __iter__(self):
        return iter(self._openers)

    def __len__(self) -> int:
        return len(self._openers)


def read_tables(spark: SparkSession, base: str, fmt: str = "parquet") -> LazyTables:
    """All five tables from ``{base}/{table}.{fmt}`` (file or directory), opened lazily."""
    reader = read_parquet_table if fmt == "parquet" else read_csv_table
    root = base.rstrip("/")
    return LazyTables({
        t: (lambda t=t: reader(spark, f"{root}/{t}.{fmt}", t)) for t in TABLE_SCHEMAS
    })


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV export with a header and ISO dates.

    ``single_file`` coalesces to one task and is meant for small result sets
    only (a report, a KPI board); large exports keep their partitioning.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)


# Partition layout for facts written as Parquet: the clock predicates
# (expiry_date > d, d < expiry_date <= d+30, sale_date > d-30) then prune
# whole directories instead of reading every file.
FACT_PARTITIONS = {"purchases_transactions": "expiry_date", "sales_transactions": "sale_date"}


def export_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "csv",
                  date_format: str = CSV_DATE_FORMAT, partition_facts: bool = False) -> list[str]:
    """Write every table to ``{base}/{table}.{fmt}`` with its declared columns
    (missing ones as typed NULLs); CSV gets a header and the shipped date
    dialect, so ``read_tables(spark, base, "csv")`` reads it back. With
    ``partition_facts`` (Parquet only) the facts are laid out by
    ``FACT_PARTITIONS``, one directory per day, after a rebalance on that day:
    a small day is written by one task, a hot day is split over several."""
    root = base.rstrip("/")
    written = []
    for name, df in tables.items():
        cols = [
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLE_SCHEMAS[name].fields
        ]
        out = df.select(cols)
        path = f"{root}/{name}.{fmt}"
        if fmt == "csv":
            out.write.mode("overwrite").option("header", True).option("dateFormat", date_format).csv(path)
        elif partition_facts and name in FACT_PARTITIONS:
            day = FACT_PARTITIONS[name]
            write_parquet(out.hint("rebalance", day), path, partition_by=[day])
        else:
            write_parquet(out, path)
        written.append(name)
    return written
