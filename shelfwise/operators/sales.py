"""Sales movement: Q6 top-20 movers over the last 30 days.

Sales are first reduced to one row per (item, day) - partial aggregation
absorbs a hot item before the shuffle - and only that reduced set meets the
item dimension. Distinct selling days stay exact because the day is part of
the reduced key. The top-k is a ``TakeOrderedAndProject`` (per-partition
top 20, then a 20-row merge), with the group keys as tiebreakers so the
choice at rank 20 is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.functions.exact import half_up_ratio
from shelfwise.sources.schemas import MONEY_SUM

TOP_N = 20
GROUP_KEYS = ["medicine_name", "category", "manufacturer", "is_emergency"]


def sales_by_item_day(sales: DataFrame, clock: Clock, window_days: int) -> DataFrame:
    q = F.col("quantity_sold")
    return (
        sales.where(clock.since(F.col("sale_date"), window_days))
        .groupBy("medicine_id", "sale_date")
        .agg(
            F.sum(q).alias("_units"),
            F.sum(q * F.col("selling_price")).alias("_revenue"),
            F.count("sale_id").alias("_n_sales"),
            F.count(q).alias("_n_qty"),
        )
    )


def sales_movement(sales: DataFrame, medicines: DataFrame, clock: Clock,
                   window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """All groups of Q6 (before the top-k), one row per item-attribute group."""
    daily = sales_by_item_day(sales, clock, window_days)
    m = medicines.select("medicine_id", *GROUP_KEYS)
    g = daily.join(m, "medicine_id", "left").groupBy(*GROUP_KEYS).agg(
        F.sum("_units").alias("_units"),
        F.countDistinct("sale_date").alias("days_sold"),
        F.sum("_revenue").alias("_revenue"),
        F.sum("_n_sales").alias("_n_sales"),
        F.sum("_n_qty").alias("_n_qty"),
    )
    units = F.coalesce(F.col("_units"), F.lit(0)).cast("bigint")
    return g.select(
        *[F.col(k).alias("_k_" + k) for k in GROUP_KEYS],
        F.coalesce("medicine_name", F.lit("Unknown")).alias("medicine_name"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("manufacturer", F.lit("Unknown")).alias("manufacturer"),
        F.coalesce("is_emergency", F.lit(0)).cast("int").alias("is_emergency"),
        units.alias("total_units_sold_30days"),
        F.col("days_sold").cast("bigint").alias("days_sold"),
        F.coalesce(F.col("_revenue"), F.lit(0)).cast(MONEY_SUM).alias("total_revenue_30days"),
        F.when(F.col("_n_sales") > 0, half_up_ratio(F.col("_units"), F.col("_n_qty"), precision=10))
        .otherwise(F.lit(0).cast("decimal(10,2)"))
        .alias("avg_units_per_sale"),
        rules.avg_daily_sales(units, window_days).alias("avg_daily_sales"),
        rules.movement_category(units, window_days).alias("movement_category"),
    )


def sales_movement_top(sales: DataFrame, medicines: DataFrame, clock: Clock,
                       n: int = TOP_N, window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """Q6: the ``n`` groups with most units sold in the window."""
    g = sales_movement(sales, medicines, clock, window_days)
    order = [F.col("total_units_sold_30days").desc()] + [
        F.col("_k_" + k).asc_nulls_first() for k in GROUP_KEYS
    ]
    return g.orderBy(*order).limit(n).drop(*["_k_" + k for k in GROUP_KEYS])


def payment_mix(sales: DataFrame) -> DataFrame:
    """Transactions per payment method and discount, and their share of all."""
    g = sales.groupBy("payment_method", "discount_percent").agg(F.count(F.lit(1)).cast("bigint").alias("transactions"))
    total = F.sum("transactions").over(Window.partitionBy())  # over the few grouped rows
    return g.select("payment_method", "discount_percent", "transactions",
                    half_up_ratio(F.col("transactions"), total, multiplier=100, precision=12).alias("share_percent"))
