"""One query per relational building block the reference relies on.

A whole query can hide a wrong join default or aggregate; each function
here isolates one construct over the domain tables so it is checked on its
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.functions.exact import half_up_ratio
from shelfwise.operators.distinct import spread_counts
from shelfwise.operators.joins import preserving_left_join
from shelfwise.sources.schemas import MONEY_SUM


def join_left_on_residual(medicines: DataFrame, purchases: DataFrame, clock: Clock) -> DataFrame:
    """Items LEFT JOIN purchases ON id AND expiry > now AND qty > 0.

    The residual filters the purchases *before* the join, so items without a
    live batch survive with NULLs (moving it to WHERE would drop them).
    """
    live = purchases.where(
        clock.after_now(F.col("expiry_date")) & (F.col("quantity_remaining") > 0)
    ).select("medicine_id", "purchase_id", "batch_no", "expiry_date", "quantity_remaining")
    return preserving_left_join(medicines.select("medicine_id", "medicine_name"), live, "medicine_id")


def join_fact_dim_orphans(purchases: DataFrame, medicines: DataFrame) -> DataFrame:
    """Purchases LEFT JOIN items; orphan batches kept as 'Unknown'."""
    m = medicines.select("medicine_id", "medicine_name", "category")
    return purchases.select("purchase_id", "medicine_id", "quantity_remaining").join(
        m, "medicine_id", "left"
    ).select(
        "purchase_id", "medicine_id",
        F.coalesce("medicine_name", F.lit("Unknown")).alias("medicine_name"),
        F.coalesce("category", F.lit("Uncategorized")).alias("category"),
        "quantity_remaining",
    )


def join_dim_fact_zero_rows(suppliers: DataFrame, purchases: DataFrame) -> DataFrame:
    """Suppliers LEFT JOIN purchases; a supplier without purchases is a row of zeros."""
    per_supplier = purchases.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("quantity_purchased").alias("_units")
    )
    return suppliers.select("supplier_id", "supplier_name").join(
        per_supplier, "supplier_id", "left"
    ).select(
        "supplier_id", "supplier_name",
        F.coalesce("_rows", F.lit(0)).cast("bigint").alias("purchase_rows"),
        F.coalesce("_units", F.lit(0)).cast("bigint").alias("units_purchased"),
    )


def join_inner_then_left(medicines: DataFrame, reorder: DataFrame, purchases: DataFrame) -> DataFrame:
    """Items JOIN rules LEFT JOIN purchases - one row per (item, batch),
    plus one row for a ruled item without batches."""
    ruled = medicines.select("medicine_id").join(
        reorder.select("medicine_id", "min_stock_level"), "medicine_id", "inner"
    )
    p = purchases.select("medicine_id", "purchase_id", "quantity_remaining")
    return preserving_left_join(ruled, p, "medicine_id")


def agg_multi_distinct(purchases: DataFrame) -> DataFrame:
    """A4: two exact distinct counts in one grouping (per supplier), from one
    scan: the rows are made distinct before they are dealt to the two counts.
    Their number (from the file footers) decides how many tasks hold them."""
    keys, counts = ["supplier_id"], {"medicine_id": "distinct_medicines", "batch_no": "distinct_batches"}
    return spread_counts(purchases, keys, counts, purchases.count())


def agg_conditional_sum(purchases: DataFrame, clock: Clock) -> DataFrame:
    """SUM(CASE WHEN p THEN x ELSE 0 END); a NULL predicate takes ELSE."""
    exp, q = F.col("expiry_date"), F.col("quantity_remaining")
    return purchases.groupBy("supplier_id").agg(
        F.sum(F.when(clock.after_now(exp), q).otherwise(F.lit(0))).cast("bigint").alias("live_units"),
        F.sum(F.when(clock.not_after(exp, 30), q * F.col("purchase_price")).otherwise(F.lit(0)))
        .cast(MONEY_SUM).alias("expiring_value"),
    )


def agg_avg_null_as_zero(medicines: DataFrame, purchases: DataFrame, clock: Clock) -> DataFrame:
    """Per category, AVG(ISNULL(price, 0)) next to AVG(price) over
    items LEFT JOIN live batches (an item without batches adds one NULL)."""
    live = purchases.where(clock.after_now(F.col("expiry_date")))
    per_item = live.groupBy("medicine_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("purchase_price").alias("_sum"),
        F.count("purchase_price").alias("_n"),
    )
    j = medicines.select("medicine_id", "category").join(per_item, "medicine_id", "left")
    g = j.groupBy("category").agg(
        F.sum(F.coalesce("_rows", F.lit(1))).alias("_rows"),
        F.sum("_sum").alias("_sum"),
        F.sum("_n").alias("_n"),
    )
    total = F.coalesce(F.col("_sum"), F.lit(0))
    return g.select(
        "category",
        half_up_ratio(total, F.col("_rows"), precision=12).alias("avg_price_null_as_zero"),
        half_up_ratio(total, F.col("_n"), precision=12).alias("avg_price_nulls_skipped"),
    )


def agg_group_non_key(sales: DataFrame, medicines: DataFrame) -> DataFrame:
    """Grouping by item *name*: same-name items merge, orphans form the NULL group."""
    per_item = sales.groupBy("medicine_id").agg(F.sum("quantity_sold").alias("_units"))
    m = medicines.select("medicine_id", F.col("medicine_id").alias("_item"), "medicine_name")
    return per_item.join(m, "medicine_id", "left").groupBy("medicine_name").agg(
        F.countDistinct("_item").alias("items"),
        F.coalesce(F.sum("_units"), F.lit(0)).cast("bigint").alias("units_sold"),
    )


def agg_group_expr(purchases: DataFrame, medicines: DataFrame) -> DataFrame:
    """GROUP BY ISNULL(category, 'Uncategorized') over purchases LEFT JOIN items."""
    per_item = purchases.groupBy("medicine_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("quantity_remaining").alias("_units")
    )
    j = per_item.join(medicines.select("medicine_id", "category"), "medicine_id", "left")
    return j.groupBy(F.coalesce("category", F.lit("Uncategorized")).alias("category")).agg(
        F.sum("_rows").cast("bigint").alias("batches"),
        F.coalesce(F.sum("_units"), F.lit(0)).cast("bigint").alias("units"),
    )


def expr_safe_ratio(purchases: DataFrame) -> DataFrame:
    """F2 + F4: CAST((sp - pp) * 100.0 / NULLIF(pp, 0) AS DECIMAL(10,2)) per batch."""
    pp, sp = F.col("purchase_price"), F.col("selling_price")
    return purchases.select(
        "purchase_id", "purchase_price", "selling_price",
        half_up_ratio(sp - pp, F.when(pp != 0, pp), multiplier=100, precision=10).alias("margin_pct"),
    )


def expr_day_bands(purchases: DataFrame, clock: Clock) -> DataFrame:
    """F9 + R7 + R8: day difference and the full risk ladder for every batch
    (expired, undated and far-off batches included)."""
    days = clock.days_until(F.col("expiry_date"))
    return purchases.select(
        "purchase_id", "expiry_date", days.alias("days_until_expiry"),
        rules.expiry_risk(days).alias("expiry_risk"),
        rules.recommended_discount(days).alias("recommended_discount"),
    )


def sort_case_rank(summary: DataFrame, reorder: DataFrame) -> DataFrame:
    """The emergency ladder's rank as a column, rows ordered by it."""
    j = summary.select("medicine_id", "current_stock").join(
        reorder.select("medicine_id", "min_stock_level"), "medicine_id", "left"
    )
    rank = rules.emergency_rank(F.col("current_stock"), F.col("min_stock_level"))
    return j.select("medicine_id", "current_stock", rank.cast("int").alias("status_rank")).orderBy(
        "status_rank", "medicine_id"
    )


def share_of_total(purchases: DataFrame, medicines: DataFrame, clock: Clock) -> DataFrame:
    """Each category's share of live stock value (total = window sum over
    the per-category rows, so the fact is read once)."""
    q, pp = F.col("quantity_remaining"), F.col("purchase_price")
    live = purchases.where(clock.after_now(F.col("expiry_date")) & (q > 0))
    per_item = live.groupBy("medicine_id").agg(F.sum(q * pp).alias("_v"))
    g = per_item.join(medicines.select("medicine_id", "category"), "medicine_id", "left").groupBy(
        F.coalesce("category", F.lit("Uncategorized")).alias("category")
    ).agg(F.coalesce(F.sum("_v"), F.lit(0)).cast(MONEY_SUM).alias("stock_value"))
    total = F.sum("stock_value").over(Window.partitionBy())  # over the categories only
    return g.select(
        "category", "stock_value",
        rules.share_percent(F.col("stock_value"), total).alias("share_pct"),
    )

