"""Calendar spine and gap-filled daily sales.

The spine covers the sales date range: one row per day, so its size is the
calendar span, not the data volume (a 1-row min/max aggregate exploded by
``sequence``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.schemas import MONEY_SUM


def _spine(bounds: DataFrame) -> DataFrame:
    days = bounds.select(
        F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("day")
    )
    wd = F.weekday("day")
    return days.select("day", wd.alias("weekday"), (wd >= 5).alias("is_weekend"))


def date_spine(sales: DataFrame) -> DataFrame:
    """Every day from the first to the last sale, with weekday
    (Monday = 0) and a weekend flag."""
    return _spine(sales.agg(F.min("sale_date").alias("_lo"), F.max("sale_date").alias("_hi")))


def daily_sales_filled(sales: DataFrame) -> DataFrame:
    """One row per spine day with transactions, units and revenue (0 on
    days without sales)."""
    q = F.col("quantity_sold")
    daily = sales.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(q).alias("_u"),
        F.sum(q * F.col("selling_price")).alias("_r"),
    )
    # The bounds come from the daily rows, so the fact is reduced once (the exchange is reused).
    spine = _spine(daily.agg(F.min("sale_date").alias("_lo"), F.max("sale_date").alias("_hi")))
    return spine.join(daily, spine["day"] == daily["sale_date"], "left").select(
        F.col("day").alias("sale_date"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("transactions"),
        F.coalesce("_u", F.lit(0)).cast("bigint").alias("units"),
        F.coalesce("_r", F.lit(0)).cast(MONEY_SUM).alias("revenue"),
        "is_weekend",
    )
