"""Stock valuation: Q3b total investment, Q4 valuation by category, and the
measures that Q4 and the drill-down (C7) share.

The unexpired purchases are read once and reduced per (item, batch) by a
map-side combining aggregate, before they meet the items: sums of units, money
and prices, the digits of the margins, and the value without the
``quantity_remaining > 0`` residual that the share of the total needs (a scalar
subquery in the reference). The two distinct counts come from the reduced rows
(``operators.distinct``). The share's denominator is a window sum over the
grouped result (one row per category, so the unpartitioned window holds only
the category vocabulary) instead of a second scan of the fact table.

The mean margin adds up exact digits (``exact.percent_digits``), so it doesn't
depend on the order of rows or the number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.functions.exact import half_up_ratio, mean_percent, percent_digits
from shelfwise.operators.distinct import distinct_counts
from shelfwise.sources.schemas import MONEY_SUM, PRICE

RISK_WINDOW_DAYS = 30
UNCATEGORIZED = "Uncategorized"

_COUNT, _WIDE = "bigint", "decimal(38,0)"
# Additive measures of a group of batches, with the type of their sums.
MEASURES = {
    "_rows": _COUNT, "_units": _COUNT, "_value": MONEY_SUM, "_revenue": MONEY_SUM, "_profit": MONEY_SUM,
    "_sum_pp": MONEY_SUM, "_n_pp": _COUNT, "_sum_sp": MONEY_SUM, "_n_sp": _COUNT, "_sum_pp0": MONEY_SUM,
    "_head": _WIDE, "_tail": _COUNT, "_n_margin": _COUNT, "_risk": MONEY_SUM, "_all_value": MONEY_SUM,
}


def total_investment(purchases: DataFrame, clock: Clock) -> DataFrame:
    """Value of live stock (1 when there is none, as the reference)."""
    q, pp = F.col("quantity_remaining"), F.col("purchase_price")
    live = purchases.where(clock.after_now(F.col("expiry_date")) & (q > 0))
    return live.agg(F.coalesce(F.sum(q * pp), F.lit(1)).cast(MONEY_SUM).alias("total_investment"))


def per_item_batch(purchases: DataFrame, clock: Clock, risk_days: int = RISK_WINDOW_DAYS) -> DataFrame:
    """(medicine_id, batch_no, MEASURES) of the unexpired purchases. All but
    ``_all_value`` count rows with ``quantity_remaining > 0`` only."""
    q, pp, sp = F.col("quantity_remaining"), F.col("purchase_price"), F.col("selling_price")
    exp = F.col("expiry_date")

    def only(c: Column) -> Column:
        return F.when(q > 0, c)

    head, tail = percent_digits(sp - pp, pp)
    sums = {
        "_rows": F.count(only(F.lit(1))), "_units": F.sum(only(q)), "_value": F.sum(only(q * pp)),
        "_revenue": F.sum(only(q * sp)), "_profit": F.sum(only(q * (sp - pp))),
        "_sum_pp": F.sum(only(pp)), "_n_pp": F.count(only(pp)), "_sum_sp": F.sum(only(sp)), "_n_sp": F.count(only(sp)),
        "_sum_pp0": F.sum(only(F.coalesce(pp, F.lit(0)))),
        "_head": F.sum(only(head).cast("decimal(20,0)")), "_tail": F.sum(only(tail)), "_n_margin": F.count(only(head)),
        "_risk": F.sum(F.when((q > 0) & clock.not_after(exp, risk_days), q * pp)), "_all_value": F.sum(q * pp),
    }
    return purchases.where(clock.after_now(exp)).groupBy("medicine_id", "batch_no").agg(
        *[c.cast(MEASURES[k]).alias(k) for k, c in sums.items()])


def with_category(reduced: DataFrame, medicines: DataFrame) -> DataFrame:
    """Adds the category, and the two values that are counted: the id of a known
    item, and the batch, both NULL where no row of them has stock."""
    m = medicines.select("medicine_id", F.col("medicine_id").alias("_known"), "category")
    live = F.col("_rows") > 0
    return reduced.join(m, "medicine_id", "left").select(
        F.coalesce("category", F.lit(UNCATEGORIZED)).alias("category"), "medicine_id",
        F.when(live, F.col("_known")).alias("_item"), F.when(live, F.col("batch_no")).alias("_batch"), *MEASURES)


def measure_columns(total: Column) -> list[Column]:
    """Q4's output measures of a grouped row with MEASURES and the two counts."""
    def money(name: str, alias: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast(MONEY_SUM).alias(alias)

    def mean_price(name: str, n: str, alias: str) -> Column:
        return F.coalesce(half_up_ratio(F.col(name), F.col(n), precision=12), F.lit(0).cast(PRICE)).alias(alias)

    value = F.coalesce(F.col("_value"), F.lit(0)).cast(MONEY_SUM)
    return [
        F.col("unique_medicines").cast("bigint").alias("unique_medicines"),
        F.col("total_batches").cast("bigint").alias("total_batches"),
        F.coalesce(F.col("_units"), F.lit(0)).cast("bigint").alias("total_units_in_stock"),
        value.alias("total_investment"),
        money("_revenue", "total_potential_revenue"),
        money("_profit", "total_expected_profit"),
        mean_price("_sum_pp", "_n_pp", "avg_purchase_price"),
        mean_price("_sum_sp", "_n_sp", "avg_selling_price"),
        F.when(F.col("_sum_pp0") > 0, mean_percent(F.col("_head"), F.col("_tail"), F.col("_n_margin")))
        .otherwise(F.lit(0).cast("decimal(10,2)")).alias("avg_margin_percentage"),
        money("_risk", "at_risk_value_next_30_days"),
        rules.share_percent(value, total).alias("percentage_of_total_value"),
    ]


def category_valuation(purchases: DataFrame, medicines: DataFrame, clock: Clock,
                       risk_days: int = RISK_WINDOW_DAYS) -> DataFrame:
    """Q4: per category counts, cost, revenue, profit, mean prices, margin,
    value expiring within ``risk_days`` and share of the total value."""
    rows = with_category(per_item_batch(purchases, clock, risk_days), medicines)
    g = distinct_counts(rows, ["category"], {"_item": "unique_medicines", "_batch": "total_batches"}, list(MEASURES))
    # The total is a window sum over the grouped rows (one per category): no
    # second pass over the fact, and the window holds only the categories.
    total = F.coalesce(F.sum("_all_value").over(Window.partitionBy()), F.lit(0)).cast(MONEY_SUM)
    out = g.withColumn("_total", total).where(F.col("_rows") > 0)
    return out.select("category", *measure_columns(F.col("_total"))).orderBy(
        F.col("total_investment").desc(), F.col("category"))
