"""Driver tables (TPC-H-like Parquet) -> the five inventory domain tables.

The mapping is fixed so that the DuckDB oracle (``plans/oracle.py``) can
build the same tables with plain SQL. Every adapter is a lazy projection /
filter over one scan (suppliers and sales add one join), so Catalyst prunes
the columns a query does not read and pushes its filters into the scan.

Orphan facts, suppliers without purchases and items without a reorder rule
do not occur in the driver tables by themselves. No row is dropped to make
them: some keys are negated, so both sides of a join keep rows without partner.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.schemas import PRICE

FIRST_DAY = dt.date(2000, 1, 1)

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day(c: Column) -> Column:
    return c.cast("date")


def _negated(key: str, chosen: Column) -> Column:
    """The key, negated for the chosen rows: a key that no other table has."""
    return F.when(chosen, -F.col(key)).otherwise(F.col(key)).cast("bigint")


def medicines(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        _negated("p_partkey", F.col("p_partkey") % 50 == 7).alias("medicine_id"),
        F.col("p_name").alias("medicine_name"),
        F.col("p_type").alias("category"),
        F.when(size % 4 == 0, "Antibiotic")
        .when(size % 4 == 1, "Hormone")
        .when(size % 4 == 2, "NSAID")
        .otherwise("PPI")
        .alias("therapeutic_class"),
        F.col("p_brand").alias("manufacturer"),
        F.concat(size.cast("string"), F.lit(" per pack")).alias("package_size"),
        F.lower("p_type").alias("unit_type"),
        F.when(size % 5 == 0, 1).otherwise(0).cast("int").alias("is_emergency"),
        F.when((F.col("p_type") == "SMALL") & (F.col("p_partkey") % 5 < 3), 1)
        .otherwise(0)
        .cast("int")
        .alias("is_refrigerated"),
        F.date_add(F.lit(FIRST_DAY), size.cast("int")).alias("created_date"),
        F.when(F.col("p_retailprice") > 0, 1).otherwise(0).cast("int").alias("is_active"),
    )


def suppliers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    # nation is the fixed 25-row TPC-H table: broadcasting it is size-safe.
    n = nation.select("n_nationkey", "n_name")
    return supplier.join(
        F.broadcast(n), supplier["s_nationkey"] == n["n_nationkey"], "inner"
    ).select(
        F.col("s_suppkey").cast("bigint").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"),
        F.concat(F.lit("Desk of "), "s_name").alias("contact_person"),
        F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("+"), F.col("s_suppkey").cast("string"))).alias("phone"),
        F.concat(F.lit("desk"), F.col("s_suppkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("city"),
        F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("GST"), F.col("s_suppkey").cast("string"))).alias("gst_number"),
        F.when(F.col("s_acctbal") >= 5000, "30 days").otherwise("15 days").alias("payment_terms"),
        (F.col("s_suppkey") % 5 + 1).cast("int").alias("lead_time_days"),
        F.when(F.col("s_acctbal") >= 0, 1).otherwise(0).cast("int").alias("is_active"),
    )


def _undated() -> Column:
    """Lines without an expiry date; never NULL, so that its negation is its complement."""
    return F.coalesce((F.col("l_linenumber") == 5) & (F.col("l_quantity") == 17), F.lit(False))


def _purchases(lineitem: DataFrame, expiry: Column) -> DataFrame:
    line = F.col("l_linenumber")
    qty = F.col("l_quantity")
    price = F.col("l_extendedprice").cast(PRICE)
    ship = _day(F.col("l_shipdate"))
    one_plus_tax = F.lit(1).cast("decimal(4,2)") + F.col("l_tax").cast("decimal(4,2)")
    return lineitem.select(
        (F.col("l_orderkey") * 10 + line).cast("bigint").alias("purchase_id"),
        F.col("l_partkey").cast("bigint").alias("medicine_id"),
        _negated("l_suppkey", F.col("l_suppkey") % 25 == 3).alias("supplier_id"),
        F.concat(F.lit("B"), (F.col("l_orderkey") % 2700).cast("string")).alias("batch_no"),
        F.date_sub(ship, 730).alias("manufacturing_date"),
        expiry.alias("expiry_date"),
        (qty.cast("int") + line * 10).cast("int").alias("quantity_purchased"),
        F.when(line == 7, F.lit(0)).otherwise(qty.cast("int")).cast("int").alias(
            "quantity_remaining"
        ),
        F.when((line == 6) & (qty == 13), F.lit(0).cast(PRICE))
        .otherwise(price)
        .alias("purchase_price"),
        (price * one_plus_tax).cast(PRICE).alias("selling_price"),
        F.when(F.col("l_returnflag") != "R", (price * F.lit(2)).cast(PRICE)).alias("mrp"),
        F.date_sub(ship, 700).alias("purchase_date"),
    )


def purchases(lineitem: DataFrame) -> DataFrame:
    """All purchases in one scan: for queries that don't filter by expiry."""
    ship = _day(F.col("l_shipdate"))
    return _purchases(lineitem, F.when(_undated(), F.lit(None).cast("date")).otherwise(ship))


def purchases_by_expiry(lineitem: DataFrame) -> DataFrame:
    """The same rows as disjoint branches, dated and undated. The expiry date of
    the first is the raw column, so a bound on it reaches the scan as a pushed
    filter; the second is a constant NULL, so the optimizer drops the whole
    branch under any predicate that rejects NULL. (Without such a predicate the
    table would be read twice: use ``purchases`` there.)"""
    dated = _purchases(lineitem.where(~_undated()), _day(F.col("l_shipdate")))
    undated = _purchases(lineitem.where(_undated()), F.lit(None).cast("date"))
    return dated.unionByName(undated)


def sales(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Sales are lineitems dated by their order.

    This is the one fact-to-fact join of the adapters; it is keyed on the
    order key, so filters on ``sale_date`` reach the orders scan and the
    runtime bloom filter trims the lineitem side before the shuffle.
    """
    o = orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    return lineitem.join(o, lineitem["l_orderkey"] == o["o_orderkey"], "inner").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("sale_id"),
        F.col("l_partkey").cast("bigint").alias("medicine_id"),
        F.col("l_quantity").cast("int").alias("quantity_sold"),
        F.col("l_extendedprice").cast(PRICE).alias("selling_price"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount_percent"),
        _day(F.col("o_orderdate")).alias("sale_date"),
        F.date_format("o_orderdate", "HH:mm").alias("sale_time"),
        F.col("o_orderpriority").alias("payment_method"),
        (F.col("l_returnflag") == "R").alias("prescription_required"),
        F.concat(F.lit("BILL"), F.col("l_orderkey").cast("string")).alias("bill_no"),
    )


def reorder_levels(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        _negated("p_partkey", F.col("p_partkey") % 10 == 0).alias("medicine_id"),
        size.cast("int").alias("min_stock_level"),
        (size * 2 + 50).cast("int").alias("max_stock_level"),
        (size * 3 + 20).cast("int").alias("reorder_quantity"),
        F.when(size % 5 == 0, 7).otherwise(5).cast("int").alias("safety_stock_days"),
        F.when(size % 7 != 0, F.date_add(F.lit(FIRST_DAY), size.cast("int"))).alias("last_updated"),
    )


def stock_movements(events: DataFrame) -> DataFrame:
    """Events as signed stock movements: +4 per 'signup', -3 per 'purchase',
    0 for events that move no stock."""
    kind = F.col("event_type")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("bigint").alias("medicine_id"),
        F.when(kind == "signup", 4).when(kind == "purchase", -3).otherwise(0).cast("int").alias("units"),
    )


class DomainTables(Mapping):
    """The five domain tables over one driver folder, each built on first use.

    A query that reads two tables does not construct (or list files for)
    the other three; the driver files themselves are opened once.
    """

    _BUILDERS = {
        "medicines_master": lambda t: medicines(t._driver("part")),
        "suppliers_master": lambda t: suppliers(t._driver("supplier"), t._driver("nation")),
        "purchases_transactions": lambda t: purchases(t._driver("lineitem")),
        "sales_transactions": lambda t: sales(t._driver("lineitem"), t._driver("orders")),
        "reorder_levels": lambda t: reorder_levels(t._driver("part")),
    }

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    @property
    def purchases_by_expiry(self) -> DataFrame:
        if "purchases_by_expiry" not in self._built:
            self._built["purchases_by_expiry"] = purchases_by_expiry(self._driver("lineitem"))
        return self._built["purchases_by_expiry"]

    def _driver(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = read_driver(self.spark, self.sf_dir, name)
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._BUILDERS[name](self)
        return self._built[name]

    def __iter__(self):
        return iter(self._BUILDERS)

    def __len__(self) -> int:
        return len(self._BUILDERS)


def domain_tables(spark: SparkSession, sf_dir: str) -> DomainTables:
    """All five domain tables, built lazily over the driver Parquet files."""
    return DomainTables(spark, sf_dir)
