"""Distribution, trend and drill-down reports (README-level capabilities;

C1 expiry bands, C2 category distribution, C4 sales trend rollup,
C5 seasonal uplift, C7 category -> item drill-down.

Every report aggregates the fact table down to one row per item (or per
item and day / month) before it meets a dimension or a ROLLUP, so the
ROLLUP's Expand and any window run over the already-reduced rows. Windows
without a partition key are used only over per-category or per-period
aggregates, whose row count is bounded by the category vocabulary or the
calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import rules
from shelfwise.functions.clock import Clock
from shelfwise.functions.exact import half_up_ratio
from shelfwise.operators import valuation
from shelfwise.operators.distinct import KIND, one_row_per_value
from shelfwise.sources.schemas import MONEY_SUM

# Expiry bands by days left (upper bounds inclusive).
BAND_CRITICAL = ("Critical", 30)
BAND_WARNING = ("Warning", 60)
BAND_SAFE = ("Safe", 90)
BAND_HEALTHY = "Healthy"
WINTER_MONTHS = (12, 1, 2)
UNCATEGORIZED = "Uncategorized"


def _live(purchases: DataFrame, clock: Clock) -> DataFrame:
    return purchases.where(
        clock.after_now(F.col("expiry_date")) & (F.col("quantity_remaining") > 0)
    )


def expiry_band_distribution(purchases: DataFrame, clock: Clock) -> DataFrame:
    """Live batches by days to expiry (<=30, 31-60, 61-90, >90)."""
    days = clock.days_until(F.col("expiry_date"))
    band = (
        F.when(days <= BAND_CRITICAL[1], BAND_CRITICAL[0])
        .when(days <= BAND_WARNING[1], BAND_WARNING[0])
        .when(days <= BAND_SAFE[1], BAND_SAFE[0])
        .otherwise(BAND_HEALTHY)
    )
    q, pp = F.col("quantity_remaining"), F.col("purchase_price")
    g = _live(purchases, clock).groupBy(band.alias("expiry_band")).agg(
        F.count(F.lit(1)).cast("bigint").alias("batches"),
        F.sum(q).cast("bigint").alias("units"),
        F.coalesce(F.sum(q * pp), F.lit(0)).cast(MONEY_SUM).alias("stock_value"),
    )
    total = F.sum("stock_value").over(Window.partitionBy())  # over the four bands
    return g.select(
        "expiry_band", "batches", "units", "stock_value",
        rules.share_percent(F.col("stock_value"), total).alias("value_share_pct"),
    )


def category_distribution(purchases: DataFrame, sales: DataFrame, medicines: DataFrame,
                          clock: Clock, window_days: int = rules.SALES_WINDOW_DAYS) -> DataFrame:
    """Per category, share of live stock value and of units sold in the
    window, and the category's rank by stock value."""
    q, pp = F.col("quantity_remaining"), F.col("purchase_price")
    value = _live(purchases, clock).groupBy("medicine_id").agg(F.sum(q * pp).alias("_v"))
    sold = (
        sales.where(clock.since(F.col("sale_date"), window_days))
        .groupBy("medicine_id")
        .agg(F.sum("quantity_sold").alias("_u"))
    )
    per_item = value.join(sold, "medicine_id", "full_outer")
    cat = F.coalesce(F.col("category"), F.lit(UNCATEGORIZED)).alias("category")
    g = per_item.join(medicines.select("medicine_id", "category"), "medicine_id", "left").groupBy(
        cat
    ).agg(
        F.coalesce(F.sum("_v"), F.lit(0)).cast(MONEY_SUM).alias("stock_value"),
        F.coalesce(F.sum("_u"), F.lit(0)).cast("bigint").alias("units_sold_30days"),
    )
    every = Window.partitionBy()  # windows over the per-category rows only
    return g.select(
        "category", "stock_value",
        rules.share_percent(F.col("stock_value"), F.sum("stock_value").over(every)).alias(
            "value_share_pct"
        ),
        "units_sold_30days",
        rules.share_percent(F.col("units_sold_30days"), F.sum("units_sold_30days").over(every))
        .alias("units_share_pct"),
        F.rank().over(Window.orderBy(F.col("stock_value").desc())).cast("int").alias("value_rank"),
    )


def sales_trend_rollup(sales: DataFrame) -> DataFrame:
    """C4: units and revenue by year / quarter / month with subtotals, and the
    change of both against the previous period of the same level.

    The calendar is dense: every month from the first to the last sale is a
    row, an empty one with 0 units, so that the previous row is the previous
    period. Changes of the first period, and of the total, are NULL. Sales
    without a date belong to no period: they make rows of their own (period
    columns NULL), count in the total, and are nobody's previous period.

    The fact is reduced to one row per month before anything else; the
    calendar, the rollup and the windows have as many rows as there are months.
    """
    monthly = sales.groupBy(F.trunc("sale_date", "month").alias("_month")).agg(
        F.sum("quantity_sold").alias("_u"),
        F.sum(F.col("quantity_sold") * F.col("selling_price")).alias("_r"),
    )
    # The bounds come from the monthly rows, so the fact is reduced once (the exchange is reused).
    bounds = monthly.agg(F.min("_month").alias("_lo"), F.max("_month").alias("_hi"))
    months = bounds.where(F.col("_lo").isNotNull()).select(
        F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("_start"))
    dense = months.join(monthly, months["_start"] == monthly["_month"], "full_outer")
    start = F.col("_start")
    rolled = dense.select(
        F.year(start).alias("year"), F.quarter(start).alias("quarter"), F.month(start).alias("month"), "_u", "_r"
    ).rollup("year", "quarter", "month").agg(
        F.coalesce(F.sum("_u"), F.lit(0)).cast("bigint").alias("units"),
        F.coalesce(F.sum("_r"), F.lit(0)).cast(MONEY_SUM).alias("revenue"),
        F.grouping_id().alias("_gid"),
    )
    level = (
        F.when(F.col("_gid") == 0, "month")
        .when(F.col("_gid") == 1, "quarter")
        .when(F.col("_gid") == 3, "year")
        .otherwise("total")
    )
    w = Window.partitionBy("_gid").orderBy("year", "quarter", "month")

    def previous(c: str):
        return F.when(F.lag("year").over(w).isNotNull(), F.lag(c).over(w))

    with_previous = rolled.withColumns({"prev_units": previous("units"), "prev_revenue": previous("revenue")})
    return with_previous.select(
        "year", "quarter", "month", level.alias("period_level"), "units", "revenue",
        "prev_units", (F.col("units") - F.col("prev_units")).alias("units_change"),
        "prev_revenue", (F.col("revenue") - F.col("prev_revenue")).cast(MONEY_SUM).alias("revenue_change"),
    )


def seasonal_uplift(sales: DataFrame, medicines: DataFrame) -> DataFrame:
    """Per category, mean daily units in Dec-Feb against the other
    months, as a percentage uplift (days without sales are not counted)."""
    per_item_day = sales.groupBy("medicine_id", "sale_date").agg(F.sum("quantity_sold").alias("_u"))
    cat = F.coalesce(F.col("category"), F.lit(UNCATEGORIZED)).alias("category")
    daily = per_item_day.join(
        medicines.select("medicine_id", "category"), "medicine_id", "left"
    ).groupBy(cat, "sale_date").agg(F.sum("_u").alias("_u"))
    winter = F.month("sale_date").isin(*WINTER_MONTHS)
    g = daily.groupBy("category").agg(
        F.count(F.when(winter, 1)).cast("bigint").alias("winter_days"),
        F.coalesce(F.sum(F.when(winter, F.col("_u"))), F.lit(0)).cast("bigint").alias("winter_units"),
        F.count(F.when(~winter, 1)).cast("bigint").alias("other_days"),
        F.coalesce(F.sum(F.when(~winter, F.col("_u"))), F.lit(0)).cast("bigint").alias("other_units"),
    )
    wu, wd, ou, od = (F.col(c) for c in ("winter_units", "winter_days", "other_units", "other_days"))
    return g.select(
        "category", "winter_days", "winter_units", "other_days", "other_units",
        half_up_ratio(wu, wd, precision=12).alias("winter_avg_daily_units"),
        half_up_ratio(ou, od, precision=12).alias("other_avg_daily_units"),
        # (wu/wd) / (ou/od) - 1, exactly: (wu*od - wd*ou) / (wd*ou)
        F.when((wd > 0) & (ou > 0),
               half_up_ratio(wu * od - wd * ou, wd * ou, multiplier=100, precision=12))
        .alias("uplift_pct"),
    )


def _to_levels(distinct: DataFrame, sums: list[str]) -> DataFrame:
    """Deal item rows (kind 0) and batch rows (kind 1) to the levels above them."""
    none, no_item = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def row(level: str, category, item, batch, of_item: bool):
        return F.struct(
            F.lit(level).alias("level"), category.alias("category"), item.alias("medicine_id"), batch.alias("_batch"),
            *[(F.col(s) if of_item else F.lit(None).cast(distinct.schema[s].dataType)).alias(s) for s in sums],
            (F.least(F.col("_known"), F.lit(1)) if of_item else no_item).alias("_items"),
            (F.col("_batches") if of_item and level == "item" else no_item).alias("_item_batches"),
        )

    category, item, batch = F.col("category"), F.col("medicine_id"), F.col("_batch")
    items = F.array(row("item", category, item, none, True), row("category", category, no_item, none, True),
                    row("total", none, no_item, none, True))
    batches = F.array(row("category", category, no_item, batch, False), row("total", none, no_item, batch, False))
    kept = distinct.where((F.col(KIND) == 0) | batch.isNotNull())
    return kept.select(F.inline(F.when(F.col(KIND) == 0, items).otherwise(batches)))


def drilldown_rollup(purchases: DataFrame, medicines: DataFrame, clock: Clock) -> DataFrame:
    """All measures of the category valuation (Q4) at three levels: item,
    category and total. A group without live stock is left out.

    The purchases are reduced per (item, batch), then to one row per item and
    one per (category, batch). Only those rows are dealt to the levels above,
    where batch rows are made distinct again, so that a batch number of many
    items or categories counts once at each level. The names meet the rows last.
    """
    sums = list(valuation.MEASURES)
    rows = valuation.with_category(valuation.per_item_batch(purchases, clock), medicines).withColumn(
        "_known", F.when(F.col("_item").isNotNull(), 1).otherwise(0).cast("bigint")
    ).withColumn("_batches", F.when(F.col("_batch").isNotNull(), 1).otherwise(0).cast("bigint"))
    distinct = one_row_per_value(rows, ["category"], ["medicine_id", "_batch"], [*sums, "_known", "_batches"])
    group, added = ["level", "category", "medicine_id"], [*sums, "_items", "_item_batches"]
    dealt = _to_levels(distinct, sums)
    once = dealt.groupBy(*group, "_batch").agg(*[F.sum(s).cast(dealt.schema[s].dataType).alias(s) for s in added])
    g = once.groupBy(*group).agg(
        *[F.sum(s).cast(dealt.schema[s].dataType).alias(s) for s in sums],
        F.coalesce(F.sum("_items"), F.lit(0)).alias("unique_medicines"),
        (F.coalesce(F.sum("_item_batches"), F.lit(0)) + F.count("_batch")).alias("total_batches"),
    ).where(F.col("_rows") > 0)
    # One narrow pass for the denominator: a window over all items would be one task.
    all_value = F.col("quantity_remaining") * F.col("purchase_price")
    total = purchases.where(clock.after_now(F.col("expiry_date"))).agg(
        F.coalesce(F.sum(all_value), F.lit(0)).cast(MONEY_SUM).alias("_total"))
    return g.crossJoin(F.broadcast(total)).join(
        medicines.select("medicine_id", "medicine_name"), "medicine_id", "left"
    ).select("level", "category", "medicine_id", "medicine_name", *valuation.measure_columns(F.col("_total")))
