"""Batch-level table operations as Spark jobs.

B10 discounted price, B13 eligible batch (FEFO), B14 prescription flag, B17
catalog flattening, B18 sequential ids, shelf life and margins of batches.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.exact import half_up_ratio
from shelfwise.session import checkpoint_dir
from shelfwise.sources.schemas import PRICE

# Fixed value: classes sold on prescription only.
PRESCRIPTION_CLASSES = ("Antibiotic", "Hormone")
SHORT_DATED_DAYS = 180
# Most items of one nested catalog row.
CATALOG_ITEMS = 1 << 13


def shelf_life(purchases: DataFrame, short_days: int = SHORT_DATED_DAYS) -> DataFrame:
    """Days from making to expiry, days left when bought, and whether a batch
    was bought short-dated."""
    left = F.datediff("expiry_date", "purchase_date")
    return purchases.select(
        "purchase_id", "medicine_id", "manufacturing_date", "expiry_date",
        F.datediff("expiry_date", "manufacturing_date").alias("shelf_days"),
        left.alias("days_left_at_purchase"),
        F.coalesce(left < short_days, F.lit(False)).alias("short_dated"),
    )


def margin_audit(purchases: DataFrame) -> DataFrame:
    """Selling against purchase price of every batch."""
    pp, sp = F.col("purchase_price"), F.col("selling_price")
    return purchases.select(
        "purchase_id", "medicine_id", "purchase_price", "selling_price",
        (sp - pp).cast(PRICE).alias("unit_margin"),
        half_up_ratio(sp - pp, pp, multiplier=100, precision=12).alias("margin_percent"),
        (sp < pp).alias("below_cost"),
    )


def discounted_price(sales: DataFrame) -> DataFrame:
    """Base price x (1 - discount / 100), half-up to cents."""
    sp, pct = F.col("selling_price"), F.col("discount_percent")
    final = (sp * (F.lit(100) - pct) * F.lit(Decimal("0.01"))).cast(PRICE)
    return sales.select("sale_id", "selling_price", "discount_percent", final.alias("final_price"))


def eligible_batches(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """For every sale, the batch it would be served from - same
    item, stock left, expiring strictly after the sale date - choosing the
    earliest expiry first (FEFO), then the lowest purchase id.

    No (sale, batch) pairs are formed. Sales reduce to distinct (item, day)
    and batches to one candidate per (item, expiry date), so each item's
    window below holds at most two rows per calendar day, however many
    sales or batches the item has. In descending date order, the last
    batch seen before a sale day is the nearest later expiry (batches on the
    same day sort after the sale day and so do not qualify). The pick is
    joined back to the sales on (item, day).
    """
    cand = (
        purchases.where((F.col("quantity_remaining") > 0) & F.col("expiry_date").isNotNull())
        .groupBy("medicine_id", F.col("expiry_date").alias("_d"))
        .agg(F.min("purchase_id").alias("_pid"))
        .select("medicine_id", "_d", F.lit(0).alias("_kind"),
                F.struct(F.col("_d").alias("expiry_date"), F.col("_pid").alias("purchase_id")).alias("_b"))
    )
    days = sales.select("medicine_id", F.col("sale_date").alias("_d")).distinct().select(
        "medicine_id", "_d", F.lit(1).alias("_kind"), F.lit(None).cast(cand.schema["_b"].dataType).alias("_b")
    )
    w = (
        Window.partitionBy("medicine_id")
        .orderBy(F.col("_d").desc(), F.col("_kind").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    picks = (
        cand.unionByName(days)
        .withColumn("_next", F.last("_b", ignorenulls=True).over(w))
        .where(F.col("_kind") == 1)
        .select("medicine_id", F.col("_d").alias("sale_date"), "_next")
    )
    return sales.select("sale_id", "medicine_id", "sale_date").join(
        picks, ["medicine_id", "sale_date"], "left"
    ).select(
        "sale_id", "medicine_id", "sale_date",
        F.col("_next.purchase_id").alias("purchase_id"),
        F.col("_next.expiry_date").alias("expiry_date"),
    )


def prescription_flag(medicines: DataFrame) -> DataFrame:
    """Prescription needed for the listed therapeutic classes."""
    return medicines.select(
        "medicine_id", "therapeutic_class",
        F.coalesce(F.col("therapeutic_class").isin(*PRESCRIPTION_CLASSES), F.lit(False)).alias(
            "prescription_required"
        ),
    )


def nest_catalog(medicines: DataFrame, most: int = CATALOG_ITEMS) -> DataFrame:
    """Catalogs of a manufacturer, each map<category, array<struct<name, pack>>>
    of at most ``most`` items.

    A manufacturer may hold any share of the items, so none is collected whole:
    items are dealt by position inside the input partitions, and every chunk of
    ``most`` rows of one partition is nested by itself, per manufacturer.
    """
    entry = F.struct(F.col("medicine_name").alias("name"), F.col("medicine_id").alias("pack"))
    dealt = medicines.select("manufacturer", "category", entry.alias("_entry"), F.monotonically_increasing_id().alias("_at"))
    dealt = dealt.withColumn("_chunk", F.col("_at") - F.pmod("_at", F.lit(most)))
    items = dealt.groupBy("manufacturer", "_chunk", "category").agg(F.collect_list("_entry").alias("items"))
    return items.groupBy("manufacturer", "_chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "items"))).alias("catalog")).drop("_chunk")


def flatten_catalog(nested: DataFrame, column: str = "catalog") -> DataFrame:
    """map<category, array<struct>> -> one row per (category, item)."""
    by_cat = nested.select(F.explode(column).alias("category", "_items"))
    return by_cat.select("category", F.explode("_items").alias("_it")).select(
        "category", F.col("_it.name").alias("medicine_name"), F.col("_it.pack").alias("pack")
    )


def sequential_id(df: DataFrame, order: list[str], start: int = 1, name: str = "seq_id") -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in the total order ``order``.

    No global single-partition window: rows are range-partitioned on the
    order (so a repeated leading key still splits on the later columns),
    sorted within each partition, numbered by their position inside it, and
    shifted by the row count of all earlier partitions (a table with one row
    per partition, so bounded by the partition count). The numbered rows are
    checkpointed in the shared folder: range bounds are sampled per plan, so
    counting and numbering must read one and the same outcome.
    """
    checkpoint_dir(df.sparkSession, local_fallback=True)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    numbered = ranged.withColumn("_mid", mid).select(
        *df.columns,
        F.shiftright("_mid", 33).alias("_part"),
        F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
    ).checkpoint()
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return numbered.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("bigint").alias(name)
    )
