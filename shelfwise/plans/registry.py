"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Every entry builds the domain tables over the driver Parquet files in
``sf_dir`` (lazily; nothing is collected) with the fixed test clock, and
returns the query's DataFrame. The keys match ``plans/oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators import (
    batches, blocks, calendar, expiry, kpi, planning, quality, sales, stock, suppliers, trends,
    valuation,
)
from shelfwise.plans.context import InventoryContext
from shelfwise.streaming import movements

Query = Callable[[SparkSession, str], DataFrame]


_CONTEXTS: dict[str, InventoryContext] = {}


def context(spark: SparkSession, sf_dir: str) -> InventoryContext:
    """One context per (session, dataset): the table definitions (and the
    driver files' listing and footers) are resolved once and reused by every
    query of the session; DataFrames are immutable plans, so sharing is safe."""
    ctx = _CONTEXTS.get(sf_dir)
    if ctx is None or ctx.spark is not spark:
        ctx = InventoryContext.from_driver(spark, sf_dir)
        _CONTEXTS[sf_dir] = ctx
    return ctx


def _q(build: Callable[[InventoryContext], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(context(spark, sf_dir))

    run.__doc__ = build.__doc__
    return run


TIER_A: dict[str, Query] = {
    "table_row_counts": _q(lambda c: kpi.table_row_counts(c.footer_tables())),
    "current_stock_summary": _q(lambda c: stock.stock_summary_report(c.stock_summary())),
    "low_stock_alert": _q(lambda c: stock.low_stock_alert(c.stock_summary(), c.reorder)),
    "expiry_alert": _q(lambda c: expiry.expiry_alert(c.purchases_by_expiry, c.medicines, c.clock)),
    "total_investment": _q(lambda c: valuation.total_investment(c.purchases_by_expiry, c.clock)),
    "category_valuation": _q(
        lambda c: valuation.category_valuation(c.purchases_by_expiry, c.medicines, c.clock)
    ),
    "emergency_status": _q(lambda c: stock.emergency_status(c.stock_summary(), c.reorder)),
    "sales_movement_top20": _q(
        lambda c: sales.sales_movement_top(c.sales, c.medicines, c.clock)
    ),
    "supplier_performance": _q(
        lambda c: suppliers.supplier_performance(c.suppliers, c.purchases, c.clock)
    ),
    "executive_kpis": _q(
        lambda c: kpi.executive_kpis(c.medicines, c.purchases_by_expiry, c.sales, c.reorder, c.clock)
    ),
    "export_stock_status": _q(
        lambda c: stock.export_stock_status(c.medicines, c.purchases_by_expiry, c.reorder, c.clock)
    ),
    "export_expiry": _q(lambda c: expiry.export_expiry(c.purchases_by_expiry, c.medicines, c.clock)),
    "kpi_union": _q(lambda c: kpi.kpi_union(c.medicines, c.reorder, c.purchases, c.clock)),
    "stock_by_name": _q(
        lambda c: stock.stock_by_name(c.medicines, c.purchases_by_expiry, c.reorder, c.clock)
    ),
}


BLOCKS: dict[str, Query] = {
    "join_left_on_residual": _q(
        lambda c: blocks.join_left_on_residual(c.medicines, c.purchases_by_expiry, c.clock)
    ),
    "join_fact_dim_orphans": _q(lambda c: blocks.join_fact_dim_orphans(c.purchases, c.medicines)),
    "join_dim_fact_zero_rows": _q(
        lambda c: blocks.join_dim_fact_zero_rows(c.suppliers, c.purchases)
    ),
    "join_inner_then_left": _q(
        lambda c: blocks.join_inner_then_left(c.medicines, c.reorder, c.purchases)
    ),
    "agg_multi_distinct": _q(lambda c: blocks.agg_multi_distinct(c.purchases)),
    "agg_conditional_sum": _q(lambda c: blocks.agg_conditional_sum(c.purchases, c.clock)),
    "agg_avg_null_as_zero": _q(
        lambda c: blocks.agg_avg_null_as_zero(c.medicines, c.purchases_by_expiry, c.clock)
    ),
    "agg_group_non_key": _q(lambda c: blocks.agg_group_non_key(c.sales, c.medicines)),
    "agg_group_expr": _q(lambda c: blocks.agg_group_expr(c.purchases, c.medicines)),
    "expr_safe_ratio": _q(lambda c: blocks.expr_safe_ratio(c.purchases)),
    "expr_day_bands": _q(lambda c: blocks.expr_day_bands(c.purchases, c.clock)),
    "sort_case_rank": _q(lambda c: blocks.sort_case_rank(c.stock_summary(), c.reorder)),
    "share_of_total": _q(lambda c: blocks.share_of_total(c.purchases_by_expiry, c.medicines, c.clock)),
}


# Criterion of the registered stock filter: the suppliers of these cities, the same share at any size.
FILTER_CITIES = [f"NATION_{i}" for i in range(15)]


def _filter_stock(c: InventoryContext) -> DataFrame:
    offered = stock.of_suppliers(c.purchases_by_expiry, c.suppliers, cities=FILTER_CITIES)
    live = stock.live_batches(offered, c.medicines, c.suppliers, c.stock_summary(), c.clock)
    return stock.filter_stock(
        live, c.clock,
        categories=["SMALL", "PROMO", "STANDARD"],
        statuses=["LOW STOCK", "ADEQUATE"],
        expiring_within=90,
    )


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements.run_movement_windows(spark, movements.event_glob(sf_dir))


def _closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements.run_closed_windows(spark, movements.event_glob(sf_dir))


def _stream_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = context(spark, sf_dir)
    return movements.run_low_stock_alert(spark, movements.event_glob(sf_dir), c.medicines, c.reorder)


TIER_C: dict[str, Query] = {
    "expiry_band_distribution": _q(lambda c: trends.expiry_band_distribution(c.purchases_by_expiry, c.clock)),
    "category_distribution": _q(
        lambda c: trends.category_distribution(c.purchases_by_expiry, c.sales, c.medicines, c.clock)
    ),
    "supplier_order_history": _q(
        lambda c: suppliers.supplier_order_history(c.suppliers, c.purchases, c.clock)
    ),
    "sales_trend_rollup": _q(lambda c: trends.sales_trend_rollup(c.sales)),
    "seasonal_uplift": _q(lambda c: trends.seasonal_uplift(c.sales, c.medicines)),
    "filter_stock": _q(_filter_stock),
    "drilldown_rollup": _q(lambda c: trends.drilldown_rollup(c.purchases_by_expiry, c.medicines, c.clock)),
    "emergency_coverage": _q(
        lambda c: planning.emergency_coverage(c.medicines, c.purchases_by_expiry, c.reorder, c.clock)
    ),
    "days_of_cover": _q(lambda c: planning.days_of_cover(c.stock_summary(), c.sales, c.clock)),
    "stock_health": _q(lambda c: planning.stock_health(c.stock_summary(), c.reorder)),
    "stockout_forecast": _q(
        lambda c: planning.stockout_forecast(
            c.medicines, c.sales, c.purchases, c.suppliers, c.reorder, c.clock
        )
    ),
    "overstock": _q(lambda c: planning.overstock(c.medicines, c.purchases_by_expiry, c.reorder, c.clock)),
    "stock_movement_windows": _stream_windows,
    "closed_movement_windows": _closed_windows,
    "low_stock_stream_alert": _stream_alert,
}


TIER_B: dict[str, Query] = {
    "null_profile": _q(lambda c: quality.null_profiles({t: c.tables[t] for t in c.tables})),
    "sales_preview": _q(lambda c: quality.preview(c.sales, ["sale_date", "sale_id"])),
    "date_range_profile": _q(lambda c: quality.date_range_profile(c.purchases, c.sales)),
    "quantity_reconciliation": _q(lambda c: quality.quantity_reconciliation(c.purchases)),
    "date_spine": _q(lambda c: calendar.date_spine(c.sales)),
    "daily_sales_filled": _q(lambda c: calendar.daily_sales_filled(c.sales)),
    "flatten_catalog": _q(lambda c: batches.flatten_catalog(batches.nest_catalog(c.medicines))),
    "sequential_id": _q(
        lambda c: batches.sequential_id(
            c.purchases.select("purchase_id", "purchase_date"),
            ["purchase_date", "purchase_id"], start=10000,
        )
    ),
    "discounted_price": _q(lambda c: batches.discounted_price(c.sales)),
    "eligible_batches": _q(lambda c: batches.eligible_batches(c.sales, c.purchases)),
    "shelf_life": _q(lambda c: batches.shelf_life(c.purchases)),
    "margin_audit": _q(lambda c: batches.margin_audit(c.purchases)),
    "payment_mix": _q(lambda c: sales.payment_mix(c.sales)),
    "reorder_minimum": _q(
        lambda c: planning.reorder_minimum(
            c.medicines, c.sales, c.purchases, c.suppliers, c.reorder, c.clock
        )
    ),
    "prescription_flag": _q(lambda c: batches.prescription_flag(c.medicines)),
}


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(TIER_A)
    out.update(BLOCKS)
    out.update(TIER_C)
    out.update(TIER_B)
    return out
