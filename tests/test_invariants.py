
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import expiry, kpi, stock, valuation
from shelfwise.plans.context import InventoryContext
from tests.conftest import SMALL_SF


@pytest.fixture(scope="module")
def ctx(spark):
    return InventoryContext.from_driver(spark, SMALL_SF)


def test_category_shares_sum_to_100(ctx):
    rows = valuation.category_valuation(ctx.purchases, ctx.medicines, ctx.clock).collect()
    total = sum(r.percentage_of_total_value for r in rows)
    assert abs(total - Decimal(100)) <= Decimal("0.005") * len(rows)


def test_item_stock_plus_orphans_equals_category_units(ctx):
    summary = stock.current_stock_summary(ctx.medicines, ctx.purchases, ctx.clock)
    item_units = summary.agg(F.sum("current_stock")).first()[0]
    live = ctx.purchases.where(
        ctx.clock.after_now(F.col("expiry_date")) & (F.col("quantity_remaining") > 0))
    orphan_units = live.join(ctx.medicines, "medicine_id", "left_anti").agg(
        F.sum("quantity_remaining")).first()[0] or 0
    cat_units = valuation.category_valuation(ctx.purchases, ctx.medicines, ctx.clock).agg(
        F.sum("total_units_in_stock")).first()[0]
    assert item_units + orphan_units == cat_units


def test_expiry_alert_is_subset_of_expiry_export(ctx):
    cols = ["medicine_name", "batch_no", "expiry_date", "quantity_remaining"]
    alert = expiry.expiry_alert(ctx.purchases, ctx.medicines, ctx.clock).select(*cols)
    export = expiry.export_expiry(ctx.purchases, ctx.medicines, ctx.clock).select(*cols)
    assert alert.count() > 0
    assert alert.exceptAll(export).count() == 0


def test_kpi_board_agrees_with_detail_queries(ctx):
    k = kpi.executive_kpis(ctx.medicines, ctx.purchases, ctx.sales, ctx.reorder, ctx.clock).first()
    summary = stock.current_stock_summary(ctx.medicines, ctx.purchases, ctx.clock)
    assert k.total_medicines == summary.count() == ctx.medicines.count()
    assert k.out_of_stock_count == summary.where("current_stock = 0").count()
    cats = valuation.category_valuation(ctx.purchases, ctx.medicines, ctx.clock)
    # quantities are non-negative, so dropping the qty > 0 residual changes no sum
    assert k.total_investment == cats.agg(F.sum("total_investment")).first()[0]
    assert k.total_investment == valuation.total_investment(ctx.purchases, ctx.clock).first()[0]
    low = stock.low_stock_alert(summary, ctx.reorder)
    assert k.low_stock_count <= low.count()


def test_low_stock_alert_shrinks_when_minimums_fall(ctx):
    summary = stock.current_stock_summary(ctx.medicines, ctx.purchases, ctx.clock)
    halved = ctx.reorder.withColumn("min_stock_level", (F.col("min_stock_level") / 2).cast("int"))
    full = stock.low_stock_alert(summary, ctx.reorder).count()
    fewer = stock.low_stock_alert(summary, halved).count()
    assert fewer <= full and full > 0
