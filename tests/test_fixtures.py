"""Hand-made edge rows (FIXTURES.md section 3) with expected labels."""

import datetime as dt
from decimal import Decimal

import pytest

from shelfwise.functions.clock import Clock
from shelfwise.operators import expiry, sales, stock, suppliers
from shelfwise.sources import schemas

CLOCK = Clock.at(dt.datetime(2001, 3, 1, 12, 0))
D = CLOCK.day


def day(n):
    return D + dt.timedelta(days=n)


def _rows(schema, dicts):
    names = [f.name for f in schema.fields]
    return [tuple(d.get(n) for n in names) for d in dicts]


def medicines_df(spark, items):
    rows = [dict(medicine_id=i, medicine_name=f"item{i}", category="Tablet",
                 therapeutic_class="PPI", manufacturer="M", is_emergency=e, is_refrigerated=0)
            for i, e in items]
    return spark.createDataFrame(_rows(schemas.MEDICINES, rows), schemas.MEDICINES)


def purchases_df(spark, batches):
    rows = []
    for n, b in enumerate(batches):
        r = dict(purchase_id=100 + n, supplier_id=1, batch_no=f"B{n}", quantity_purchased=100,
                 purchase_price=Decimal("10.00"), selling_price=Decimal("12.00"),
                 manufacturing_date=day(-700), purchase_date=day(-690))
        r.update(b)
        rows.append(r)
    return spark.createDataFrame(_rows(schemas.PURCHASES, rows), schemas.PURCHASES)


def reorder_df(spark, rules):
    rows = [dict(medicine_id=i, min_stock_level=m, max_stock_level=500, reorder_quantity=40,
                 safety_stock_days=5) for i, m in rules]
    return spark.createDataFrame(_rows(schemas.REORDER, rows), schemas.REORDER)


# id, stock, emergency, min (None = no rule)
LADDER = [
    (1, 0, 0, 10), (2, 9, 0, 10), (3, 10, 0, 10), (4, 10, 0, 11), (5, 29, 0, 30),
    (6, 30, 1, 30), (7, 60, 1, 30), (8, 0, 1, 30), (9, 0, 0, None), (10, 5, 1, None),
    (11, 99, 0, 10), (12, 100, 0, 10),
]


@pytest.fixture(scope="module")
def ladder(spark):
    med = medicines_df(spark, [(i, e) for i, _, e, _ in LADDER])
    pur = purchases_df(spark, [dict(medicine_id=i, expiry_date=day(100), quantity_remaining=s)
                               for i, s, _, _ in LADDER if s > 0])
    rl = reorder_df(spark, [(i, m) for i, _, _, m in LADDER if m is not None])
    summary = stock.current_stock_summary(med, pur, CLOCK)
    return med, pur, rl, summary


def test_status_bands(ladder):
    *_, summary = ladder
    got = {r.medicine_id: r.stock_status for r in summary.collect()}
    assert got == {1: "OUT OF STOCK", 2: "LOW STOCK", 3: "LOW STOCK", 4: "LOW STOCK",
                   5: "LOW STOCK", 6: "ADEQUATE", 7: "ADEQUATE", 8: "OUT OF STOCK",
                   9: "OUT OF STOCK", 10: "LOW STOCK", 11: "ADEQUATE", 12: "HIGH STOCK"}


def test_low_stock_alert_rows(ladder):
    _, _, rl, summary = ladder
    got = {r.medicine_name: (r.shortage_quantity, r.stock_percentage, r.alert_priority,
                             r.recommended_action)
           for r in stock.low_stock_alert(summary, rl).collect()}
    assert got == {
        "item1": (10, Decimal("0.00"), "2-CRITICAL - OUT OF STOCK", "URGENT - ORDER IMMEDIATELY"),
        "item2": (1, Decimal("90.00"), "3-HIGH - VERY LOW", "ORDER TODAY"),
        "item4": (1, Decimal("90.91"), "4-MEDIUM - LOW STOCK", "ORDER THIS WEEK"),
        "item5": (1, Decimal("96.67"), "4-MEDIUM - LOW STOCK", "ORDER THIS WEEK"),
        "item6": (0, Decimal("100.00"), "1-EMERGENCY", "MONITOR"),
        "item8": (30, Decimal("0.00"), "1-EMERGENCY", "URGENT - ORDER IMMEDIATELY"),
    }


def test_emergency_report_rows(ladder):
    _, _, rl, summary = ladder
    rows = stock.emergency_status(summary, rl).collect()
    got = {r.medicine_name: (r.emergency_status, r.emergency_deficit, r.action_required) for r in rows}
    assert got == {
        "item6": ("🟡 WARNING - BELOW EMERGENCY LEVEL", 30, "ORDER 40 UNITS NOW"),
        "item7": ("🟢 ADEQUATE", 0, "NO ACTION NEEDED"),
        "item8": ("🔴 CRITICAL - OUT OF STOCK", 60, "ORDER 40 UNITS NOW"),
        "item10": ("🟠 EMERGENCY - BELOW NORMAL", 55, "ORDER 50 UNITS NOW"),
    }
    # ordered critical -> below normal -> warning -> adequate
    assert [r.medicine_name for r in rows] == ["item8", "item10", "item6", "item7"]


EXPIRY = [(-1, 1), (0, 1), (1, 1), (7, 1), (8, 1), (15, 1), (16, 1), (30, 1), (31, 1),
          (None, 1), (5, 0)]


@pytest.fixture(scope="module")
def expiry_batches(spark):
    med = medicines_df(spark, [(1, 0)])
    pur = purchases_df(spark, [dict(medicine_id=1, expiry_date=None if o is None else day(o),
                                    quantity_remaining=q) for o, q in EXPIRY])
    return med, pur


def test_expiry_alert_ladder(expiry_batches):
    med, pur = expiry_batches
    got = sorted((r.days_until_expiry, r.expiry_risk, r.recommended_discount)
                 for r in expiry.expiry_alert(pur, med, CLOCK).collect())
    assert got == [
        (1, "CRITICAL - SELL NOW", "50% DISCOUNT"), (7, "CRITICAL - SELL NOW", "50% DISCOUNT"),
        (8, "HIGH - URGENT", "30% DISCOUNT"), (15, "HIGH - URGENT", "30% DISCOUNT"),
        (16, "MEDIUM - PLAN DISCOUNT", "20% DISCOUNT"), (30, "MEDIUM - PLAN DISCOUNT", "20% DISCOUNT"),
    ]


def test_live_stock_and_export_windows(expiry_batches):
    med, pur = expiry_batches
    summary = stock.current_stock_summary(med, pur, CLOCK).collect()[0]
    assert summary.current_stock == 7  # d+1 .. d+31 with quantity 1
    exported = sorted(r.days_remaining for r in expiry.export_expiry(pur, med, CLOCK).collect())
    assert exported == [1, 7, 8, 15, 16, 30, 31]


def test_supplier_expiring_includes_expired(spark, expiry_batches):
    _, pur = expiry_batches
    sup = spark.createDataFrame(
        _rows(schemas.SUPPLIERS, [dict(supplier_id=1, supplier_name="S", city="C", lead_time_days=2)]),
        schemas.SUPPLIERS,
    )
    r = suppliers.supplier_performance(sup, pur, CLOCK).collect()[0]
    # expiring: d-1, d, d+1..d+30 (8 batches) and the empty d+5 batch; value uses remaining units
    assert r.expiring_stock_value == Decimal("80.00")
    # purchased units: 11 batches x 100; the 9 expiring ones carry 900
    assert r.percentage_expiring_soon == Decimal("81.82")
    assert r.current_stock_from_supplier == 7


def test_sales_window_has_no_upper_bound(spark):
    med = medicines_df(spark, [(1, 0)])
    rows = [dict(sale_id=i, medicine_id=1, quantity_sold=1, selling_price=Decimal("1.00"),
                 sale_date=day(o)) for i, o in enumerate([-31, -30, -29, 0, 5])]
    s = spark.createDataFrame(_rows(schemas.SALES, rows), schemas.SALES)
    r = sales.sales_movement_top(s, med, CLOCK).collect()[0]
    assert (r.total_units_sold_30days, r.days_sold) == (3, 3)


def test_midnight_clock_makes_lower_bounds_inclusive(spark):
    from pyspark.sql import functions as F

    midnight = Clock.at(dt.datetime(2001, 3, 1))
    df = spark.createDataFrame([(day(0),), (day(30),), (day(-30),)], "d date")
    got = df.select(midnight.within_next(F.col("d"), 30).alias("w"),
                    midnight.since(F.col("d"), 30).alias("s")).collect()
    assert [(r.w, r.s) for r in got] == [(True, True), (True, True), (False, True)]
    got = df.select(CLOCK.within_next(F.col("d"), 30).alias("w"),
                    CLOCK.since(F.col("d"), 30).alias("s")).collect()
    assert [(r.w, r.s) for r in got] == [(False, True), (True, True), (False, False)]
