"""Stock position per item: Q1 summary, Q2 low-stock alert, Q5 emergency
report, Q10a stock export, Q12 stock by name.

Plan shape shared by all of them: the purchases fact is reduced to one row
per ``medicine_id`` first (partial aggregation before the shuffle, so an
item holding a third of all rows costs one row per map task, and where its
distinct batches are counted one per map task and batch), and only that per-item result is joined to the item and reorder dimensions. The
dimension joins are therefore 1:1 on the key and never skewed. Spark picks
broadcast or shuffle for them from measured sizes (AQE); nothing here
forces a broadcast of a table that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock

ITEM_KEYS = [
    "medicine_id", "medicine_name", "category", "therapeutic_class",
    "manufacturer", "is_emergency", "is_refrigerated",
]


def live_stock_by_item(purchases: DataFrame, clock: Clock, positive_only: bool = True) -> DataFrame:
    """Per item: units, distinct batches, expiry range of unexpired batches.

    ``positive_only`` keeps the ``quantity_remaining > 0`` residual of the
    stock summary; the exports (Q10a, Q12) sum without it.
    """
    cond = clock.after_now(F.col("expiry_date"))
    if positive_only:
        cond = cond & (F.col("quantity_remaining") > 0)
    return (
        purchases.where(cond)
        .groupBy("medicine_id")
        .agg(
            F.sum("quantity_remaining").alias("_units"),
            F.countDistinct("batch_no").alias("_batches"),
            F.min("expiry_date").alias("_earliest"),
            F.max("expiry_date").alias("_latest"),
        )
    )


def current_stock_summary(medicines: DataFrame, purchases: DataFrame, clock: Clock) -> DataFrame:
    """Q1: every item (also those without stock) with its live stock and status band.

    Equivalent to ``items LEFT JOIN purchases ON id AND expiry > now AND
    qty > 0 GROUP BY the seven item columns``; the regroup after the join
    keeps that result exact even if an item row were duplicated.
    """
    per_item = live_stock_by_item(purchases, clock, positive_only=True)
    joined = medicines.select(*ITEM_KEYS).join(per_item, "medicine_id", "left")
    grouped = joined.groupBy(*ITEM_KEYS).agg(
        F.coalesce(F.sum("_units"), F.lit(0)).cast("bigint").alias("current_stock"),
        F.coalesce(F.max("_batches"), F.lit(0)).cast("bigint").alias("total_batches"),
        F.min("_earliest").alias("earliest_expiry"),
        F.max("_latest").alias("latest_expiry"),
    )
    return grouped.withColumn("stock_status", rules.stock_status(F.col("current_stock")))


def stock_summary_report(summary: DataFrame) -> DataFrame:
    """Q1 as shown by the script: the summary ordered by stock, largest first."""
    return summary.orderBy(F.col("current_stock").desc(), F.col("medicine_id").asc())


def low_stock_alert(summary: DataFrame, reorder: DataFrame) -> DataFrame:
    """Q2: items below their minimum (emergency items: below twice the minimum)."""
    rl = reorder.select("medicine_id", "min_stock_level", "reorder_quantity")
    j = summary.join(rl, "medicine_id", "left")
    stock, mn, emerg = F.col("current_stock"), F.col("min_stock_level"), F.col("is_emergency")
    return (
        j.where(rules.is_low_stock_alert(stock, mn, emerg))
        .select(
            "medicine_name", "category", "manufacturer", "is_emergency", "current_stock",
            F.coalesce(mn, F.lit(0)).cast("int").alias("min_stock_level"),
            F.coalesce(F.col("reorder_quantity"), F.lit(0)).cast("int").alias("reorder_quantity"),
            rules.shortage_quantity(stock, mn).alias("shortage_quantity"),
            rules.stock_percentage(stock, mn).alias("stock_percentage"),
            rules.alert_priority(stock, mn, emerg).alias("alert_priority"),
            rules.recommended_action(stock, mn).alias("recommended_action"),
        )
        .orderBy("alert_priority", "current_stock", "medicine_name")
    )


def emergency_status(summary: DataFrame, reorder: DataFrame) -> DataFrame:
    """Q5: emergency items against 2x their minimum, defaults 30 / 60 / 50."""
    rl = reorder.select("medicine_id", "min_stock_level", "reorder_quantity")
    j = summary.where(F.col("is_emergency") == 1).join(rl, "medicine_id", "left")
    stock, mn = F.col("current_stock"), F.col("min_stock_level")
    return (
        j.select(
            "medicine_name", "category", "manufacturer", "current_stock",
            F.coalesce(mn, F.lit(rules.EMERGENCY_DEFAULT_MIN)).cast("int").alias("normal_minimum"),
            rules.emergency_required(mn).cast("int").alias("emergency_required_stock"),
            rules.emergency_deficit(stock, mn).alias("emergency_deficit"),
            rules.emergency_status(stock, mn).alias("emergency_status"),
            rules.action_required(stock, mn, F.col("reorder_quantity")).alias("action_required"),
            rules.emergency_rank(stock, mn).alias("_rank"),
        )
        .orderBy("_rank", "current_stock", "medicine_name")
        .drop("_rank")
    )


def _stock_with_rules(medicines: DataFrame, purchases: DataFrame, reorder: DataFrame,
                      clock: Clock, item_cols: list[str], rule_cols: list[str]) -> DataFrame:
    """items LEFT JOIN live purchases (no qty residual) LEFT JOIN reorder rules."""
    per_item = live_stock_by_item(purchases, clock, positive_only=False).select(
        "medicine_id", "_units"
    )
    return (
        medicines.select(*item_cols)
        .join(per_item, "medicine_id", "left")
        .join(reorder.select("medicine_id", *rule_cols), "medicine_id", "left")
    )


def export_stock_status(medicines: DataFrame, purchases: DataFrame, reorder: DataFrame,
                        clock: Clock) -> DataFrame:
    """Stock, minimum, reorder quantity and a YES/NO low flag per item."""
    keys = ["medicine_id", "medicine_name", "category", "is_emergency",
            "min_stock_level", "reorder_quantity"]
    j = _stock_with_rules(medicines, purchases, reorder, clock,
                          ["medicine_id", "medicine_name", "category", "is_emergency"],
                          ["min_stock_level", "reorder_quantity"])
    g = j.groupBy(*keys).agg(F.coalesce(F.sum("_units"), F.lit(0)).cast("bigint").alias("current_stock"))
    stock, mn = F.col("current_stock"), F.col("min_stock_level")
    return g.select(
        "medicine_id", "medicine_name", "category", "is_emergency", "current_stock",
        F.coalesce(mn, F.lit(0)).cast("int").alias("min_stock_level"),
        F.coalesce(F.col("reorder_quantity"), F.lit(0)).cast("int").alias("reorder_quantity"),
        rules.is_low_stock(stock, mn).alias("is_low_stock"),
    ).orderBy("medicine_name", "medicine_id")


def stock_by_name(medicines: DataFrame, purchases: DataFrame, reorder: DataFrame,
                  clock: Clock) -> DataFrame:
    """Q12: stock grouped by item *name* (same-name items merge), minimum default 30."""
    j = _stock_with_rules(medicines, purchases, reorder, clock,
                          ["medicine_id", "medicine_name", "category", "is_emergency"],
                          ["min_stock_level"])
    g = j.groupBy("medicine_name", "category", "is_emergency", "min_stock_level").agg(
        F.coalesce(F.sum("_units"), F.lit(0)).cast("bigint").alias("current_stock")
    )
    return g.select(
        "medicine_name", "category", "is_emergency", "current_stock",
        F.coalesce(F.col("min_stock_level"), F.lit(rules.NAME_DEFAULT_MIN)).cast("int").alias(
            "min_stock_level"
        ),
    ).orderBy("current_stock", "medicine_name")


def of_suppliers(purchases: DataFrame, suppliers: DataFrame, cities: list[str] | None = None,
                 max_lead_time_days: int | None = None) -> DataFrame:
    """C6's supplier criterion: the purchases from suppliers with the given
    attributes, by a semi-join on the id. The suppliers are chosen in their own
    table, so the criterion holds however many they are, and the chosen ids can
    filter the scan of the purchases at run time."""
    chosen = suppliers
    if cities is not None:
        chosen = chosen.where(F.col("city").isin(*cities))
    if max_lead_time_days is not None:
        chosen = chosen.where(F.col("lead_time_days") <= max_lead_time_days)
    return purchases.join(chosen.select("supplier_id"), "supplier_id", "left_semi")


def live_batches(purchases: DataFrame, medicines: DataFrame, suppliers: DataFrame,
                 summary: DataFrame, clock: Clock) -> DataFrame:
    """Unexpired, non-empty batches with item, supplier and item status columns."""
    p = purchases.where(
        clock.after_now(F.col("expiry_date")) & (F.col("quantity_remaining") > 0)
    ).select("purchase_id", "medicine_id", "supplier_id", "batch_no", "expiry_date",
             "quantity_remaining")
    return (
        p.join(medicines.select("medicine_id", "medicine_name", "category"), "medicine_id", "left")
        .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id", "left")
        .join(summary.select("medicine_id", "stock_status"), "medicine_id", "left")
        .select("purchase_id", "medicine_id", "supplier_id", "batch_no", "expiry_date",
                "quantity_remaining", "medicine_name", "category", "supplier_name", "stock_status")
    )


def filter_stock(batches: DataFrame, clock: Clock, categories: list[str] | None = None,
                 suppliers: list[str] | None = None, expiring_within: int | None = None,
                 statuses: list[str] | None = None) -> DataFrame:
    """The conjunction of whichever criteria are given (None = no filter)."""
    conds = []
    if categories is not None:
        conds.append(F.col("category").isin(*categories))
    if suppliers is not None:
        conds.append(F.col("supplier_name").isin(*suppliers))
    if expiring_within is not None:
        conds.append(clock.not_after(F.col("expiry_date"), expiring_within))
    if statuses is not None:
        conds.append(F.col("stock_status").isin(*statuses))
    out = batches
    for c in conds:
        out = out.where(c)
    return out
