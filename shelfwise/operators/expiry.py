"""Batch-level expiry reports: Q3 expiry alert, Q10b expiry export.

Both are per-batch outputs, so the (possibly skewed) purchases are the left,
preserved side of ``purchases LEFT JOIN items``: for a left outer join AQE's
skew handling can split the left side's partitions (it could not split the
right side). The date window is applied before the join and reaches the
Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.sources.schemas import MONEY_SUM, PRICE

ALERT_WINDOW_DAYS = 30


def expiry_alert(purchases: DataFrame, medicines: DataFrame, clock: Clock,
                 window_days: int = ALERT_WINDOW_DAYS) -> DataFrame:
    """Q3: in-stock batches expiring within the window, with value and risk labels."""
    exp, qty = F.col("expiry_date"), F.col("quantity_remaining")
    p = purchases.where(
        exp.isNotNull() & clock.within_next(exp, window_days) & (F.coalesce(qty, F.lit(0)) > 0)
    )
    m = medicines.select("medicine_id", "medicine_name", "category", "manufacturer")
    days = clock.days_until(exp)
    out = p.join(m, "medicine_id", "left").select(
        F.coalesce("medicine_name", F.lit("Unknown")).alias("medicine_name"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("manufacturer", F.lit("Unknown")).alias("manufacturer"),
        F.coalesce("batch_no", F.lit("N/A")).alias("batch_no"),
        "manufacturing_date",
        "expiry_date",
        F.coalesce(qty, F.lit(0)).cast("int").alias("quantity_remaining"),
        F.coalesce("purchase_price", F.lit(0)).cast(PRICE).alias("purchase_price"),
        F.coalesce("selling_price", F.lit(0)).cast(PRICE).alias("selling_price"),
        F.coalesce(qty * F.col("purchase_price"), F.lit(0)).cast(MONEY_SUM).alias("total_cost_value"),
        days.alias("days_until_expiry"),
        rules.expiry_risk(days).alias("expiry_risk"),
        rules.recommended_discount(days).alias("recommended_discount"),
    )
    # The reference's order, then tiebreakers: a range partitioner can split
    # a date that holds many batches only if the sort key distinguishes them.
    return out.orderBy(F.col("expiry_date").asc(), F.col("quantity_remaining").desc(),
                       "medicine_name", "batch_no", "total_cost_value")


def export_expiry(purchases: DataFrame, medicines: DataFrame, clock: Clock) -> DataFrame:
    """Every live batch (no window cap) with its loss if it expired."""
    exp, qty = F.col("expiry_date"), F.col("quantity_remaining")
    p = purchases.where(clock.after_now(exp) & (qty > 0))
    m = medicines.select("medicine_id", "medicine_name")
    return (
        p.join(m, "medicine_id", "left")
        .select(
            F.coalesce("medicine_name", F.lit("Unknown")).alias("medicine_name"),
            "batch_no",
            "expiry_date",
            "quantity_remaining",
            "purchase_price",
            (qty * F.col("purchase_price")).cast(MONEY_SUM).alias("loss_if_expired"),
            clock.days_until(exp).alias("days_remaining"),
        )
        .orderBy("expiry_date", "medicine_name", "batch_no", "quantity_remaining")
    )
