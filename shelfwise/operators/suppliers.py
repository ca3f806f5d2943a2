"""Supplier performance (Q7) and order history.

The reference writes ``suppliers LEFT JOIN purchases GROUP BY name, city,
lead time``. At scale that puts the purchases fact on the side of an outer join
that AQE cannot split, drags the name through the shuffle of the fact, and its
two distinct counts copy every joined row. Here

  1. every group of equal attributes gets the smallest of its supplier ids as
     its key (suppliers with the same attributes are one group);
  2. purchases are reduced per (supplier, item) by a map-side combining
     aggregate, meet the group key, and give items and all sums per group;
  3. the orders of a group come from a branch of two columns: (supplier,
     order) meets the group key and is made distinct;
  4. the attribute groups are left-joined to 2. and 3. on the key, with zeros
     for groups without purchases. Names appear only here.

The two branches read different columns of the fact (3. reads two), and no
aggregate copies its rows. A supplier id that occurs twice in the suppliers
table counts its purchases once for each occurrence, as the plain join does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.sources.schemas import MONEY_SUM

KEYS = ["supplier_name", "city", "lead_time_days"]
EXPIRY_WINDOW_DAYS = 30
# Additive measures per (supplier, item), with the type of their sums.
MEASURES = {"_qp": "bigint", "_value": MONEY_SUM, "_stock": "bigint", "_expiring": MONEY_SUM, "_qp_soon": "bigint"}


def _per_supplier_item(purchases: DataFrame, clock: Clock, window_days: int) -> DataFrame:
    qp, q, pp = F.col("quantity_purchased"), F.col("quantity_remaining"), F.col("purchase_price")
    exp = F.col("expiry_date")
    soon = clock.not_after(exp, window_days)
    sums = {
        "_qp": qp, "_value": qp * pp, "_stock": F.when(clock.after_now(exp), q),
        "_expiring": F.when(soon, q * pp), "_qp_soon": F.when(soon, qp),
    }
    return purchases.groupBy("supplier_id", "medicine_id").agg(
        *[F.sum(c).cast(MEASURES[k]).alias(k) for k, c in sums.items()])


def _items_and_sums(per_item: DataFrame, key: str) -> DataFrame:
    """Distinct items and total measures per ``key`` of (key, medicine_id, MEASURES) rows."""
    once = per_item.groupBy(key, "medicine_id").agg(*[F.sum(m).cast(t).alias(m) for m, t in MEASURES.items()])
    return once.groupBy(key).agg(
        F.count("medicine_id").alias("_items"), *[F.sum(m).cast(t).alias(m) for m, t in MEASURES.items()])


def _measure_columns() -> list:
    qp_total = F.coalesce(F.col("_qp"), F.lit(0)).cast("bigint")
    return [
        F.coalesce("_orders", F.lit(0)).cast("bigint").alias("total_purchase_orders"),
        F.coalesce("_items", F.lit(0)).cast("bigint").alias("unique_medicines_supplied"),
        qp_total.alias("total_units_purchased"),
        F.coalesce("_value", F.lit(0)).cast(MONEY_SUM).alias("total_purchase_value"),
        F.coalesce("_stock", F.lit(0)).cast("bigint").alias("current_stock_from_supplier"),
        F.coalesce("_expiring", F.lit(0)).cast(MONEY_SUM).alias("expiring_stock_value"),
        rules.share_percent(F.coalesce("_qp_soon", F.lit(0)), qp_total).alias("percentage_expiring_soon"),
    ]


def supplier_performance(suppliers: DataFrame, purchases: DataFrame, clock: Clock,
                         window_days: int = EXPIRY_WINDOW_DAYS) -> DataFrame:
    """Q7: orders, items, units, value, live stock and expiring share per supplier."""
    groups = suppliers.groupBy(*KEYS).agg(F.min("supplier_id").alias("_group"))
    of_group = groups.select("_group", *[F.col(k).alias("_g_" + k) for k in KEYS])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_g_" + k)) for k in KEYS])
    member = suppliers.join(of_group, same, "inner").select("_group", "supplier_id")
    sums = _items_and_sums(
        _per_supplier_item(purchases, clock, window_days).join(member, "supplier_id", "inner"), "_group")
    orders = purchases.select("supplier_id", "purchase_id").join(member, "supplier_id", "inner").select(
        "_group", "purchase_id").distinct().groupBy("_group").agg(F.count("purchase_id").alias("_orders"))
    j = groups.join(sums, "_group", "left").join(orders, "_group", "left")
    return j.select(
        F.coalesce("supplier_name", F.lit("Unknown")).alias("supplier_name"),
        F.coalesce("city", F.lit("Unknown")).alias("city"),
        F.coalesce("lead_time_days", F.lit(0)).cast("int").alias("lead_time_days"),
        *_measure_columns(),
    ).orderBy(
        F.col("percentage_expiring_soon").asc(), F.col("total_purchase_value").desc(),
        "supplier_name", "city",
    )


def supplier_order_history(suppliers: DataFrame, purchases: DataFrame, clock: Clock,
                           window_days: int = EXPIRY_WINDOW_DAYS) -> DataFrame:
    """Per supplier and purchase month - orders, units and spend - beside
    the supplier's lead time and its measures of Q7 over all months. Purchases
    are reduced per (supplier, month) and per (supplier, item) before they meet
    the supplier table (one row per supplier)."""
    month = F.trunc(F.col("purchase_date"), "month").alias("order_month")
    qp = F.col("quantity_purchased")
    per_order = purchases.groupBy("supplier_id", month, "purchase_id").agg(
        F.sum(qp).cast("bigint").alias("_u"), F.sum(qp * F.col("purchase_price")).cast(MONEY_SUM).alias("_s"))
    monthly = per_order.groupBy("supplier_id", "order_month").agg(
        F.count("purchase_id").alias("orders"),
        F.sum("_u").cast("bigint").alias("units_purchased"),
        F.coalesce(F.sum("_s"), F.lit(0)).cast(MONEY_SUM).alias("spend"),
    )
    sums = _items_and_sums(_per_supplier_item(purchases, clock, window_days), "supplier_id")
    # An order can span months: its distinct count over all of them is a branch of its own.
    orders = purchases.select("supplier_id", "purchase_id").distinct().groupBy("supplier_id").agg(
        F.count("purchase_id").alias("_orders"))
    s = suppliers.select("supplier_id", "supplier_name", "lead_time_days").join(
        sums, "supplier_id", "left").join(orders, "supplier_id", "left")
    return monthly.join(s, "supplier_id", "inner").select(
        "supplier_id", "supplier_name", "lead_time_days", "order_month",
        F.col("orders").cast("bigint").alias("orders"), "units_purchased", "spend", *_measure_columns(),
    ).orderBy("supplier_id", "order_month")
