"""Coverage, health and replenishment planning (README-level capabilities;

C8 emergency coverage, C9 days of cover, C10 stock health, C11 stock-out
forecast, C12 overstock.

All of them start from per-item aggregates of the facts (one row per item),
so every join below is 1:1 on ``medicine_id`` and skew-free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.functions.exact import half_up_ratio, int_div
from shelfwise.sources.schemas import MONEY_SUM


def _live_per_item(purchases: DataFrame, clock: Clock) -> DataFrame:
    q, pp = F.col("quantity_remaining"), F.col("purchase_price")
    return (
        purchases.where(clock.after_now(F.col("expiry_date")) & (q > 0))
        .groupBy("medicine_id")
        .agg(F.sum(q).alias("_stock"), F.sum(q * pp).alias("_value"))
    )


def _sold_per_item(sales: DataFrame, clock: Clock, window_days: int) -> DataFrame:
    return (
        sales.where(clock.since(F.col("sale_date"), window_days))
        .groupBy("medicine_id")
        .agg(F.sum("quantity_sold").alias("_sold"))
    )


# No date is forecast further ahead than a hundred years.
FORECAST_DAYS = 36500


def emergency_coverage(medicines: DataFrame, purchases: DataFrame, reorder: DataFrame,
                       clock: Clock) -> DataFrame:
    """Share of emergency items holding at least their emergency level
    (2 x min, 60 without a rule) and their share of live stock value."""
    per_item = _live_per_item(purchases, clock)
    items = medicines.select(
        F.col("medicine_id").alias("_item_id"), "is_emergency", F.lit(True).alias("_is_item")
    )
    rl = reorder.select(F.col("medicine_id").alias("_rule_id"), "min_stock_level")
    j = per_item.join(items, per_item["medicine_id"] == items["_item_id"], "full_outer").join(
        rl, F.col("_item_id") == F.col("_rule_id"), "left"
    )
    emerg = F.col("_is_item").isNotNull() & (F.col("is_emergency") == 1)
    stock = F.coalesce(F.col("_stock"), F.lit(0))
    covered = emerg & (stock >= rules.emergency_required(F.col("min_stock_level")))
    g = j.agg(
        F.count(F.when(emerg, 1)).cast("bigint").alias("emergency_items"),
        F.count(F.when(covered, 1)).cast("bigint").alias("covered_items"),
        F.coalesce(F.sum(F.when(emerg, F.col("_value"))), F.lit(0)).cast(MONEY_SUM).alias(
            "emergency_stock_value"
        ),
        F.coalesce(F.sum("_value"), F.lit(0)).cast(MONEY_SUM).alias("total_stock_value"),
    )
    return g.select(
        "emergency_items", "covered_items",
        rules.share_percent(F.col("covered_items"), F.col("emergency_items")).alias("coverage_pct"),
        "emergency_stock_value", "total_stock_value",
        rules.share_percent(F.col("emergency_stock_value"), F.col("total_stock_value")).alias(
            "emergency_value_share_pct"
        ),
    )


def days_of_cover(summary: DataFrame, sales: DataFrame, clock: Clock,
                  window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """Current stock / average daily sales of the window (NULL without sales)."""
    sold = _sold_per_item(sales, clock, window_days)
    j = summary.select("medicine_id", "medicine_name", "current_stock").join(
        sold, "medicine_id", "left"
    )
    units = F.coalesce(F.col("_sold"), F.lit(0)).cast("bigint")
    stock = F.col("current_stock")
    return j.select(
        "medicine_id", "medicine_name", "current_stock",
        units.alias("units_sold_30days"),
        rules.avg_daily_sales(units, window_days).alias("avg_daily_sales"),
        # stock / (units / window) = stock * window / units
        half_up_ratio(stock * window_days, units, precision=20).alias("days_of_cover"),
    )


def stock_health(summary: DataFrame, reorder: DataFrame) -> DataFrame:
    """Share of items with a reorder rule that raise no low-stock alert."""
    ruled = summary.join(reorder.select("medicine_id", "min_stock_level"), "medicine_id", "inner")
    alert = rules.is_low_stock_alert(
        F.col("current_stock"), F.col("min_stock_level"), F.col("is_emergency")
    )
    g = ruled.agg(
        F.count(F.lit(1)).cast("bigint").alias("ruled_items"),
        F.count(F.when(alert, 1)).cast("bigint").alias("alerted_items"),
    )
    healthy = F.col("ruled_items") - F.col("alerted_items")
    return g.select(
        "ruled_items", "alerted_items", healthy.alias("healthy_items"),
        rules.share_percent(healthy, F.col("ruled_items")).alias("stock_health_pct"),
    )


def _supply_and_demand(medicines: DataFrame, sales: DataFrame, purchases: DataFrame, suppliers: DataFrame,
                       reorder: DataFrame, clock: Clock, window_days: int, rule: str) -> DataFrame:
    """Per item: live stock, slowest lead time of its suppliers, units sold in
    the window, and the column ``rule`` of its rule. Purchases are read once, reduced per (item,
    supplier) to the live stock and the pair itself; the supplier lead time
    joins those pairs (a row per pair, not per batch)."""
    q = F.col("quantity_remaining")
    live = clock.after_now(F.col("expiry_date")) & (q > 0)
    pairs = purchases.groupBy("medicine_id", "supplier_id").agg(F.sum(F.when(live, q)).alias("_s"))
    per_item = (
        pairs.join(suppliers.select("supplier_id", "lead_time_days"), "supplier_id", "left")
        .groupBy("medicine_id")
        .agg(F.sum("_s").alias("_stock"), F.max("lead_time_days").alias("lead_time_days"))
    )
    return (
        medicines.select("medicine_id")
        .join(per_item, "medicine_id", "left")
        .join(_sold_per_item(sales, clock, window_days), "medicine_id", "left")
        .join(reorder.select("medicine_id", rule), "medicine_id", "left")
    )


def stockout_forecast(medicines: DataFrame, sales: DataFrame, purchases: DataFrame,
                      suppliers: DataFrame, reorder: DataFrame, clock: Clock,
                      window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """C11: projected stock-out date (now + floor(days of cover)) and a
    reorder alert when cover < slowest lead time + safety stock days. The
    date is NULL beyond ``FORECAST_DAYS``; the cover is given in full."""
    j = _supply_and_demand(medicines, sales, purchases, suppliers, reorder, clock, window_days, "safety_stock_days")
    units = F.coalesce(F.col("_sold"), F.lit(0)).cast("bigint")
    stock = F.coalesce(F.col("_stock"), F.lit(0)).cast("bigint")
    cover_days = F.when(units > 0, int_div(stock * window_days, F.when(units > 0, units)))
    horizon = F.coalesce("lead_time_days", F.lit(0)) + F.coalesce("safety_stock_days", F.lit(0))
    # cover < horizon  <=>  stock * window < horizon * units  (exact, no division)
    alert = (units > 0) & (stock * window_days < horizon * units)
    return j.select(
        "medicine_id", stock.alias("current_stock"), units.alias("units_sold_30days"),
        cover_days.alias("cover_days"),
        F.when((units > 0) & (cover_days <= FORECAST_DAYS),
               F.date_add(clock.lit_day(), cover_days.cast("int"))).alias("stockout_date"),
        F.col("lead_time_days").cast("int").alias("lead_time_days"),
        F.col("safety_stock_days").cast("int").alias("safety_stock_days"),
        F.when(alert, "YES").otherwise("NO").alias("reorder_alert"),
    )


def overstock(medicines: DataFrame, purchases: DataFrame, reorder: DataFrame,
              clock: Clock) -> DataFrame:
    """Items whose live stock exceeds max_stock_level; excess units and
    their value at the item's average live unit cost."""
    per_item = _live_per_item(purchases, clock)
    j = per_item.join(
        medicines.select("medicine_id", "medicine_name"), "medicine_id", "inner"
    ).join(reorder.select("medicine_id", "max_stock_level"), "medicine_id", "inner")
    stock, mx = F.col("_stock"), F.col("max_stock_level")
    excess = (stock - mx).cast("bigint")
    return j.where(stock > mx).select(
        "medicine_id", "medicine_name",
        stock.cast("bigint").alias("current_stock"), "max_stock_level",
        excess.alias("excess_units"),
        F.col("_value").cast(MONEY_SUM).alias("stock_value"),
        half_up_ratio(excess * F.col("_value"), stock).alias("excess_value"),
    )


def reorder_minimum(medicines: DataFrame, sales: DataFrame, purchases: DataFrame, suppliers: DataFrame,
                    reorder: DataFrame, clock: Clock, window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """Units an item sells during its slowest supplier's lead time, at the
    rate of the last ``window_days``, against its rule's minimum."""
    d = _supply_and_demand(medicines, sales, purchases, suppliers, reorder, clock, window_days, "min_stock_level").select(
        "medicine_id", F.coalesce(F.col("_sold"), F.lit(0)).cast("bigint").alias("units_sold_30days"),
        F.col("lead_time_days").cast("int").alias("lead_time_days"), "min_stock_level")
    need = int_div(F.col("units_sold_30days") * F.coalesce("lead_time_days", F.lit(0)) + (window_days - 1), F.lit(window_days).cast("bigint"))
    return d.select(
        "medicine_id", "units_sold_30days", "lead_time_days", "min_stock_level", need.alias("demand_in_lead_time"),
        F.greatest(need - F.coalesce("min_stock_level", F.lit(0)), F.lit(0)).cast("bigint").alias("minimum_gap"))
