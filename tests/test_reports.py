"""Reports of this package at other clocks, on gappy data, and under other partitionings."""

import datetime as dt
import importlib.util
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfwise.functions import clock as clock_module
from shelfwise.functions.exact import half_up_ratio, mean_percent, percent_digits
from shelfwise.operators import distinct, quality, stock, suppliers, trends, valuation
from shelfwise.plans import oracle, registry
from shelfwise.plans.context import InventoryContext
from shelfwise.sources import adapters, schemas
from tests.compare import compare, duck_connection
from tests.conftest import SMALL_SF

MIDNIGHT = dt.datetime(2001, 3, 1)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL_SF)


@pytest.fixture(scope="module")
def at_midnight():
    """Registry results and oracle SQL with the pinned clock at midnight."""
    real = clock_module.DEFAULT_AS_OF
    clock_module.DEFAULT_AS_OF = MIDNIGHT
    try:
        spec = importlib.util.spec_from_file_location("oracle_at_midnight", oracle.__file__)
        fresh = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(fresh)
        return fresh.oracle_queries()
    finally:
        clock_module.DEFAULT_AS_OF = real


CLOCKED = sorted(n for n, sql in oracle.oracle_queries().items() if "2001-0" in sql)


@pytest.mark.parametrize("name", CLOCKED)
def test_every_clocked_query_equals_its_oracle_at_midnight(spark, con, at_midnight, monkeypatch, name):
    ctx = InventoryContext.from_driver(spark, SMALL_SF, as_of=MIDNIGHT)
    monkeypatch.setattr(registry, "context", lambda *_: ctx)
    ok, msg = compare(registry.all_queries()[name](spark, SMALL_SF), con, at_midnight[name])
    assert ok, f"{name}: {msg}"


def test_midnight_changes_the_kpi_board(spark, con, at_midnight):
    """Batches that expire today count as expiring at midnight, so the two clocks differ here."""
    noon, midnight = oracle.oracle_queries()["executive_kpis"], at_midnight["executive_kpis"]
    assert con.sql(noon).fetchall() != con.sql(midnight).fetchall()


# --- exact ratios -----------------------------------------------------------

def _cents(x: Fraction) -> Decimal:
    sign = -1 if x < 0 else 1
    return sign * Decimal((abs(x) * 100 + Fraction(1, 2)).__floor__()) / 100


def test_both_ratio_paths_agree_with_fractions(spark):
    rng = random.Random(4)
    pairs = [(Decimal(rng.randrange(-10 ** d, 10 ** d)).scaleb(-2), Decimal(rng.randrange(-10 ** e, 10 ** e)).scaleb(-2))
             for d in (2, 5, 11, 14, 15, 18) for e in (2, 5, 11, 15) for _ in range(15)]
    pairs += [(Decimal("0.05"), Decimal("10.00")), (Decimal("-0.05"), Decimal("10.00")), (Decimal("999999999999.99"), Decimal("0.01")),
              (Decimal("1000000000000.00"), Decimal("3.00")), (Decimal("1.00"), Decimal("0.00")), (None, Decimal("1.00"))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a decimal(20,2), b decimal(20,2)")
    for multiplier in (1, 100):
        got = df.select("i", half_up_ratio(F.col("a"), F.col("b"), multiplier, precision=30).alias("r")).collect()
        for r in got:
            a, b = pairs[r.i]
            assert r.r == (None if a is None or not b else _cents(Fraction(a) * multiplier / Fraction(b))), (a, b)


def test_mean_of_ratios_is_exact_and_free_of_order(spark):
    rng = random.Random(9)
    rows = [(Decimal(rng.randrange(1, 10 ** rng.randrange(1, 9))).scaleb(-2), Decimal(rng.randrange(0, 10 ** 8)).scaleb(-2)) for _ in range(4000)]
    rows += [(Decimal("0.00"), Decimal("5.00")), (None, Decimal("5.00")), (Decimal("3.00"), None)]
    ratios = [(Fraction(s) - Fraction(p)) * 100 / Fraction(p) for p, s in rows if p and s is not None]
    want = _cents(sum(ratios) / len(ratios))
    seen = set()
    for parts in (1, 8, 64):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "p decimal(12,2), s decimal(12,2)").repartition(parts)
        head, tail = percent_digits(F.col("s") - F.col("p"), F.col("p"))
        row = df.agg(F.sum(head.cast("decimal(20,0)")).alias("h"), F.sum(tail).alias("t"), F.count(head).alias("n"))
        seen.add(row.select(mean_percent(F.col("h"), F.col("t"), F.col("n"), 20).alias("m")).first().m)
    assert seen == {want}


def test_category_margin_is_the_same_under_any_partitioning(spark):
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            shuffled = ctx.purchases.orderBy(F.rand(int(parts))).repartition(int(parts))
            seen.append(sorted(map(tuple, valuation.category_valuation(shuffled, ctx.medicines, ctx.clock).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 3


# --- distinct counts --------------------------------------------------------

def test_distinct_counts_equal_the_plain_aggregate(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)]), rng.choice([None, "a", "b", "c"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, a long, b string, v long")
    reduced = df.groupBy("k", "a", "b").agg(F.sum("v").alias("v"))
    got = distinct.distinct_counts(reduced, ["k"], {"a": "na", "b": "nb"}, ["v"])
    want = df.groupBy("k").agg(F.countDistinct("a").alias("na"), F.countDistinct("b").alias("nb"), F.sum("v").alias("v"))
    assert set(map(tuple, got.collect())) == set(map(tuple, want.select(*got.columns).collect()))
    assert distinct.distinct_counts(reduced.limit(0), ["k"], {"a": "na", "b": "nb"}, ["v"]).count() == 0


def test_suppliers_of_equal_attributes_are_one_group(spark):
    s = spark.createDataFrame([(1, "A", "X", 2), (2, "A", "X", 2), (3, None, None, None), (4, None, None, None), (5, "B", "Y", 1)],
                              "supplier_id long, supplier_name string, city string, lead_time_days int")
    d = dt.date(2001, 3, 10)
    p = spark.createDataFrame(
        [(10, 1, 1, d, 5, 5, Decimal("2.00")), (10, 1, 2, d, 5, 5, Decimal("2.00")), (11, 2, 2, None, 7, 0, Decimal("1.00")),
         (12, 1, 3, d, 1, 1, Decimal("1.00")), (13, 9, 99, d, 1, 1, Decimal("1.00")), (14, None, 4, d, 2, None, None)],
        "purchase_id long, medicine_id long, supplier_id long, expiry_date date, quantity_purchased int, quantity_remaining int, purchase_price decimal(12,2)")
    got = {r.supplier_name: tuple(r)[3:] for r in suppliers.supplier_performance(s, p, clock_module.Clock.at("2001-03-01T12:00")).collect()}
    z = Decimal("0.00")
    assert got == {
        "A": (2, 2, 17, Decimal("27.00"), 10, Decimal("20.00"), Decimal("58.82")),
        "Unknown": (2, 1, 3, Decimal("1.00"), 1, Decimal("1.00"), Decimal("100.00")),
        "B": (0, 0, 0, z, 0, z, z)}


def test_drilldown_counts_a_shared_batch_once_per_level(spark):
    m = spark.createDataFrame([(1, "one", "C"), (2, "two", "C"), (3, "three", "D")], "medicine_id long, medicine_name string, category string")
    d = dt.date(2001, 6, 1)
    rows = [(1, "B1", d, 4, Decimal("2.00"), Decimal("3.00")), (1, "B2", d, 1, Decimal("2.00"), Decimal("2.00")), (2, "B1", d, 1, Decimal("1.00"), Decimal("1.00")),
            (3, "B1", d, 2, Decimal("5.00"), Decimal("4.00")), (9, "B9", d, 1, Decimal("1.00"), Decimal("1.00")), (3, None, d, 1, Decimal("0.00"), Decimal("1.00")),
            (2, "B7", d, 0, Decimal("1.00"), Decimal("1.00")), (2, "B8", dt.date(2001, 1, 1), 5, Decimal("1.00"), Decimal("1.00"))]
    p = spark.createDataFrame(rows, "medicine_id long, batch_no string, expiry_date date, quantity_remaining int, purchase_price decimal(12,2), selling_price decimal(12,2)")
    got = {(r.level, r.category, r.medicine_id): r for r in trends.drilldown_rollup(p, m, clock_module.Clock.at("2001-03-01T12:00")).collect()}
    counts = {k: (r.unique_medicines, r.total_batches, r.total_units_in_stock, r.total_investment) for k, r in got.items()}
    assert counts == {
        ("item", "C", 1): (1, 2, 5, Decimal("10.00")), ("item", "C", 2): (1, 1, 1, Decimal("1.00")), ("item", "D", 3): (1, 1, 3, Decimal("10.00")),
        ("item", "Uncategorized", 9): (0, 1, 1, Decimal("1.00")), ("category", "C", None): (2, 2, 6, Decimal("11.00")),
        ("category", "D", None): (1, 1, 3, Decimal("10.00")), ("category", "Uncategorized", None): (0, 1, 1, Decimal("1.00")),
        ("total", None, None): (3, 3, 10, Decimal("22.00"))}
    assert got["item", "C", 1].medicine_name == "one" and got["total", None, None].percentage_of_total_value == Decimal("100.00")
    assert got["item", "C", 1].avg_margin_percentage == Decimal("25.00")
    assert trends.drilldown_rollup(p.limit(0), m, clock_module.Clock.at("2001-03-01T12:00")).count() == 0


# --- trend ------------------------------------------------------------------

def test_trend_with_months_removed_equals_its_oracle(spark):
    con = duck_connection(SMALL_SF)
    gap = "NOT (o_orderdate >= '1996-04-01' AND o_orderdate < '1996-07-01' OR o_orderdate >= '1997-02-01' AND o_orderdate < '1997-03-01')"
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM read_parquet('{SMALL_SF}/orders.parquet') WHERE {gap}")
    orders = spark.read.parquet(f"{SMALL_SF}/orders.parquet").where(gap)
    got = trends.sales_trend_rollup(adapters.sales(spark.read.parquet(f"{SMALL_SF}/lineitem.parquet"), orders))
    ok, msg = compare(got, con, oracle.oracle_queries()["sales_trend_rollup"])
    assert ok, msg
    rows = {(r.period_level, r.year, r.quarter, r.month): r for r in got.collect()}
    assert rows["month", 1996, 2, 5].units == 0 and rows["month", 1996, 2, 5].units_change == 0
    assert rows["quarter", 1996, 2, None].units == 0 and rows["quarter", 1996, 3, None].prev_units == 0
    assert rows["month", 1997, 1, 3].prev_units == 0 and rows["month", 1997, 1, 3].revenue_change == rows["month", 1997, 1, 3].revenue


def test_undated_sales_are_nobodys_previous_period(spark):
    sales = spark.createDataFrame(
        [(1, dt.date(2000, 12, 5), Decimal("2.00")), (2, dt.date(2001, 2, 5), Decimal("1.00")), (4, None, Decimal("1.00"))],
        "quantity_sold int, sale_date date, selling_price decimal(12,2)")
    rows = {(r.period_level, r.year, r.month): (r.units, r.prev_units) for r in trends.sales_trend_rollup(sales).collect() if r.quarter or r.period_level != "quarter"}
    assert rows["month", 2000, 12] == (1, None) and rows["month", 2001, 1] == (0, 1) and rows["month", 2001, 2] == (2, 0)
    assert rows["total", None, None] == (7, None)
    assert all(r.units == 0 for r in trends.sales_trend_rollup(sales.limit(0)).collect())


# --- filter, profile, preview -----------------------------------------------

def test_supplier_criterion_is_a_semi_join(spark):
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    chosen = [r.supplier_id for r in ctx.suppliers.where(F.col("city").isin("NATION_3", "NATION_8")).collect()]
    got = stock.of_suppliers(ctx.purchases, ctx.suppliers, cities=["NATION_3", "NATION_8"])
    assert chosen and got.count() == ctx.purchases.where(F.col("supplier_id").isin(chosen)).count() > 0
    twice = ctx.suppliers.unionByName(ctx.suppliers)
    assert stock.of_suppliers(ctx.purchases, twice, cities=["NATION_3", "NATION_8"]).count() == got.count()
    assert stock.of_suppliers(ctx.purchases, ctx.suppliers, max_lead_time_days=0).count() == 0


def test_every_declared_column_is_profiled(spark):
    tables = InventoryContext.from_driver(spark, SMALL_SF).tables
    for name, schema in schemas.TABLE_SCHEMAS.items():
        assert [(f.name, f.dataType) for f in tables[name].schema.fields] == [(f.name, f.dataType) for f in schema.fields]
    rows = quality.null_profiles(dict(tables)).collect()
    assert len(rows) == sum(len(s.fields) for s in schemas.TABLE_SCHEMAS.values()) == 49
    assert {r.column_name for r in rows if r.null_count} >= {"expiry_date", "phone", "mrp", "last_updated"}


def test_preview_shows_the_same_rows_whatever_the_partitioning(spark):
    rows = [(i % 3, i % 5, f"x{i}") for i in range(60)]
    shown = {tuple(map(tuple, quality.preview(spark.createDataFrame(random.Random(n).sample(rows, 60), "a int, b int, c string")
                                              .repartition(n), ["a"], 7).collect())) for n in (1, 3, 8)}
    assert shown == {tuple(sorted(rows)[:7])}
    assert quality.preview(spark.createDataFrame([], "a int"), ["a"]).count() == 0


def test_entry_survives_a_broken_training_data_folder(monkeypatch):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "shelfwise.llm.queries", None)  # importing it raises ImportError
    with pytest.warns(UserWarning) if importlib.util.find_spec("shelfwise.llm") else _nothing():
        assert set(entry.queries()) == set(registry.all_queries())
    assert set(entry.oracle_sql()) == set(oracle.oracle_queries())


def _nothing():
    import contextlib

    return contextlib.nullcontext()
