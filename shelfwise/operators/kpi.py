"""Counts and the one-row KPI board: Q0 row counts, Q8 executive KPIs,
Q11 metric/value union.

Q8 in the reference is eleven scalar subqueries, four of them over the
purchases table with different filters; Catalyst keeps one scan per
subquery. Here each source is read once: purchases are reduced to one row
per item over the unexpired window (all four purchase KPIs and the stock
figure needed by the alert counts are conditional sums of that pass), and
the 1-row results are cross-joined (1-row broadcasts).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.clock import Clock
from shelfwise.sources.schemas import MONEY_SUM

RISK_WINDOW_DAYS = 30
SALES_WINDOW_DAYS = 30


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Q0: (Table_Name, Total_Rows) for the given tables, in the given order."""
    parts = [
        df.agg(F.count(F.lit(1)).cast("bigint").alias("Total_Rows")).select(
            F.lit(name).alias("Table_Name"), "Total_Rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _one_row_join(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)


def executive_kpis(medicines: DataFrame, purchases: DataFrame, sales: DataFrame,
                   reorder: DataFrame, clock: Clock) -> DataFrame:
    """Q8: one row, eleven KPIs."""
    q, pp, sp = F.col("quantity_remaining"), F.col("purchase_price"), F.col("selling_price")
    exp = F.col("expiry_date")
    # "expiry > now", and "expiry BETWEEN now AND now + 30", which at midnight starts
    # a day earlier: the rows are cut to the union of both, the sums to their own range.
    live = clock.after_now(exp)

    per_item = (
        purchases.where(clock.not_before(exp))
        .groupBy("medicine_id")
        .agg(
            F.count(F.when(live, 1)).alias("_rows"),
            F.sum(F.when(live & (q > 0), q)).alias("_stock"),
            F.sum(F.when(clock.within_next(exp, RISK_WINDOW_DAYS), q * pp)).alias("_risk"),
            F.sum(F.when(live, q * pp)).alias("_inv"),
            F.sum(F.when(live, q * sp)).alias("_rev"),
        )
    )
    # Items and per-item purchases meet in one FULL OUTER join on the key
    # (both sides have one row per item, so it is never skewed); unmatched
    # purchase rows are orphans, which count for the purchase KPIs only.
    # medicine_id is the key of both dimensions (as in the reference's data
    # model), so the joins do not fan out.
    items = medicines.select(
        F.col("medicine_id").alias("_item_id"), "is_emergency", F.lit(True).alias("_is_item")
    )
    rules_ = reorder.select(F.col("medicine_id").alias("_rule_id"), "min_stock_level")
    j = (
        per_item.join(items, per_item["medicine_id"] == items["_item_id"], "full_outer")
        .join(rules_, F.col("_item_id") == F.col("_rule_id"), "left")
    )
    is_item = F.col("_is_item").isNotNull()
    cs = F.coalesce(F.col("_stock"), F.lit(0))
    mn = F.col("min_stock_level")
    emerg = F.col("is_emergency") == 1
    k_stock = j.agg(
        F.count(F.when(is_item, 1)).cast("bigint").alias("total_medicines"),
        F.count(F.when(is_item & emerg, 1)).cast("bigint").alias("emergency_medicines"),
        F.count(F.when(F.col("_rows") > 0, F.col("medicine_id"))).cast("bigint").alias("medicines_in_stock"),
        F.count(F.when(is_item & (cs < mn), 1)).cast("bigint").alias("low_stock_count"),
        F.count(F.when(is_item & (cs == 0), 1)).cast("bigint").alias("out_of_stock_count"),
        F.count(F.when(is_item & emerg & (cs < mn * 2), 1)).cast("bigint").alias(
            "emergency_low_count"
        ),
        F.coalesce(F.sum("_risk"), F.lit(0)).cast(MONEY_SUM).alias("expiry_risk_value_30days"),
        F.coalesce(F.sum("_inv"), F.lit(0)).cast(MONEY_SUM).alias("total_investment"),
        F.coalesce(F.sum("_rev"), F.lit(0)).cast(MONEY_SUM).alias("potential_revenue"),
    )

    qs = F.col("quantity_sold")
    k_sales = sales.where(clock.since(F.col("sale_date"), SALES_WINDOW_DAYS)).agg(
        F.coalesce(F.sum(qs), F.lit(0)).cast("bigint").alias("total_units_sold_30days"),
        F.coalesce(F.sum(qs * F.col("selling_price")), F.lit(0)).cast(MONEY_SUM).alias(
            "total_revenue_30days"
        ),
    )
    return _one_row_join([k_stock, k_sales]).select(
        "total_medicines", "emergency_medicines", "medicines_in_stock",
        "low_stock_count", "out_of_stock_count", "emergency_low_count",
        "expiry_risk_value_30days", "total_investment", "potential_revenue",
        "total_units_sold_30days", "total_revenue_30days",
    )


def kpi_union(medicines: DataFrame, reorder: DataFrame, purchases: DataFrame,
              clock: Clock, window_days: int = RISK_WINDOW_DAYS) -> DataFrame:
    """Q11: (Metric, Value) rows.

    'LOW STOCK ITEMS' counts (item, batch) rows of ``items JOIN rules LEFT
    JOIN purchases`` whose remaining quantity (0 if none) is under the
    item's minimum - expired batches included, as in the reference. The
    batches are read once and reduced to a per-item quantity histogram that
    also carries the expiring-batch count, so the join carries one row per
    (item, distinct quantity) instead of one per batch, and a FULL OUTER join
    keeps the histogram rows of items without a rule for the expiring count.
    """
    items = medicines.select(F.col("medicine_id").alias("_item_id"))
    total = items.agg(F.count(F.lit(1)).cast("bigint").alias("Value")).select(
        F.lit("TOTAL MEDICINES").alias("Metric"), "Value"
    )
    hist = purchases.groupBy("medicine_id", "quantity_remaining").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(clock.within_next(F.col("expiry_date"), window_days), 1)).alias("_exp"),
    )
    ruled = items.join(
        reorder.select(F.col("medicine_id").alias("_rule_id"), "min_stock_level"),
        F.col("_item_id") == F.col("_rule_id"), "inner",
    )
    j = ruled.join(hist, ruled["_item_id"] == hist["medicine_id"], "full_outer")
    low = F.when(
        F.col("_item_id").isNotNull()
        & (F.coalesce("quantity_remaining", F.lit(0)) < F.col("min_stock_level")),
        F.coalesce("_n", F.lit(1)),
    )
    g = j.agg(
        F.coalesce(F.sum(low), F.lit(0)).cast("bigint").alias("_low"),
        F.coalesce(F.sum("_exp"), F.lit(0)).cast("bigint").alias("_exp"),
    )
    rest = g.select(
        F.inline(F.array(
            F.struct(F.lit("LOW STOCK ITEMS").alias("Metric"), F.col("_low").alias("Value")),
            F.struct(F.lit("EXPIRING IN 30 DAYS").alias("Metric"), F.col("_exp").alias("Value")),
        ))
    )
    return total.unionByName(rest)
