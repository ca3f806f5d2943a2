"""Run context: the five tables, one clock, one stock summary.

The reference keeps a session temp table (the stock summary) that later
queries read, and re-reads "now" in every statement. Here the clock is fixed
once per context and the summary is built once; ``materialize_stock``
persists it (MEMORY_AND_DISK, recomputed from lineage if an executor is
lost) or writes it as a checkpoint under the cluster's shared
``spark.checkpoint.dir`` when lineage should be cut.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from shelfwise.functions.clock import DEFAULT_AS_OF, Clock
from shelfwise.operators import stock
from shelfwise.session import checkpoint_dir, footer_session
from shelfwise.sources import adapters, readers

STOCK_VIEW = "current_stock_summary"


class InventoryContext:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], as_of=None,
                 reopen: Callable[[SparkSession], Mapping[str, DataFrame]] | None = None):
        self.spark = spark
        self._reopen = reopen  # opens the same tables in another session
        self.clock = Clock.now() if as_of is None else Clock.at(as_of)
        self.tables = tables  # may be lazy (adapters.DomainTables)
        self._stock: DataFrame | None = None
        self._persisted = False

    # -- construction -----------------------------------------------------
    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str, as_of=DEFAULT_AS_OF) -> "InventoryContext":
        return cls(spark, adapters.domain_tables(spark, sf_dir), as_of,
                   lambda s: adapters.domain_tables(s, sf_dir))

    @classmethod
    def from_files(cls, spark: SparkSession, base: str, fmt: str = "parquet",
                   as_of=None) -> "InventoryContext":
        return cls(spark, readers.read_tables(spark, base, fmt), as_of,
                   lambda s: readers.read_tables(s, base, fmt))

    def footer_tables(self) -> Mapping[str, DataFrame]:
        """The tables, opened so that counts and bounds of plain columns come from
        the Parquet footers (``session.footer_session``)."""
        return self.tables if self._reopen is None else self._reopen(footer_session(self.spark))

    @property
    def medicines(self) -> DataFrame:
        return self.tables["medicines_master"]

    @property
    def suppliers(self) -> DataFrame:
        return self.tables["suppliers_master"]

    @property
    def purchases(self) -> DataFrame:
        return self.tables["purchases_transactions"]

    @property
    def purchases_by_expiry(self) -> DataFrame:
        """The purchases, for queries whose predicate rejects a NULL expiry: a
        source that computes the date offers a form whose scan takes the bound."""
        return getattr(self.tables, "purchases_by_expiry", None) or self.purchases

    @property
    def sales(self) -> DataFrame:
        return self.tables["sales_transactions"]

    @property
    def reorder(self) -> DataFrame:
        return self.tables["reorder_levels"]

    # -- the shared stock summary (Q1) --------------------------------------
    def stock_summary(self) -> DataFrame:
        if self._stock is None:
            self._stock = stock.current_stock_summary(self.medicines, self.purchases_by_expiry, self.clock)
        return self._stock

    def materialize_stock(self, checkpoint: bool = False) -> DataFrame:
        """Pin the stock summary so that every alert reads one snapshot (IO7)."""
        df = self.stock_summary()
        if checkpoint:
            checkpoint_dir(self.spark)  # must be the shared folder on a cluster
            df = df.checkpoint(eager=True)
        else:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            self._persisted = True
        self._stock = df
        df.createOrReplaceTempView(STOCK_VIEW)
        return df

    def drop_stock_views(self) -> dict[str, bool]:
        """Q9: release the summary and drop the temp views if present."""
        if self._stock is not None and self._persisted:
            self._stock.unpersist()
        self._stock, self._persisted = None, False
        return {
            name: self.spark.catalog.dropTempView(name)
            for name in (STOCK_VIEW,)
        }
