"""Label and edge-case counts at sf0.001 equal the coverage table of
FIXTURES.md section 2 (recorded independently of this implementation)."""

from pyspark.sql import functions as F

from shelfwise.operators import sales
from shelfwise.plans import registry
from tests.conftest import SMALL_SF


def _dist(df, col):
    return {r[0]: r[1] for r in df.groupBy(col).count().collect()}


def test_label_coverage_matches_fixture_table(spark):
    q = registry.all_queries()
    assert _dist(q["current_stock_summary"](spark, SMALL_SF), "stock_status") == {
        "OUT OF STOCK": 23, "LOW STOCK": 32, "ADEQUATE": 106, "HIGH STOCK": 39}
    assert _dist(q["low_stock_alert"](spark, SMALL_SF), "alert_priority") == {
        "1-EMERGENCY": 20, "2-CRITICAL - OUT OF STOCK": 14, "3-HIGH - VERY LOW": 6,
        "4-MEDIUM - LOW STOCK": 9}
    assert _dist(q["emergency_status"](spark, SMALL_SF), "emergency_status") == {
        "🔴 CRITICAL - OUT OF STOCK": 4, "🟠 EMERGENCY - BELOW NORMAL": 9,
        "🟡 WARNING - BELOW EMERGENCY LEVEL": 11, "🟢 ADEQUATE": 15}
    c = registry.context(spark, SMALL_SF)
    assert _dist(sales.sales_movement(c.sales, c.medicines, c.clock), "movement_category") == {
        "NORMAL MOVING": 36, "SLOW MOVING": 100, "VERY SLOW MOVING": 33}


def test_edge_case_coverage_matches_fixture_table(spark):
    c = registry.context(spark, SMALL_SF)
    pur = c.purchases
    counts = [c.medicines.count(), c.suppliers.count(), pur.count(), c.sales.count(), c.reorder.count()]
    assert counts == [200, 10, 6000, 6000, 200]  # every row of the driver tables
    raw = [c.spark.read.parquet(f"{SMALL_SF}/{t}.parquet").count() for t in ("part", "supplier", "lineitem")]
    assert counts[:3] == raw
    assert pur.join(c.medicines, "medicine_id", "left_anti").count() == 125
    assert c.medicines.join(c.reorder, "medicine_id", "left_anti").count() == 23
    assert c.suppliers.join(pur, "supplier_id", "left_anti").count() == 1
    assert (pur.where("purchase_price = 0").count(), pur.where("expiry_date IS NULL").count(),
            pur.where("quantity_remaining = 0").count()) == (13, 15, 918)
    live = pur.where(c.clock.after_now(F.col("expiry_date")) & (F.col("quantity_remaining") > 0))
    d = c.clock.days_until(F.col("expiry_date"))
    band = (F.when(d <= 7, 7).when(d <= 15, 15).when(d <= 30, 30).when(d <= 60, 60)
            .when(d <= 90, 90).otherwise(999))
    assert _dist(live.withColumn("b", band), "b") == {7: 17, 15: 20, 30: 28, 60: 66, 90: 49, 999: 309}
