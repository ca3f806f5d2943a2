"""Exact rounding, skew-safe joins, sequential ids, FEFO picks, context and I/O."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shelfwise.functions.clock import DEFAULT_AS_OF, Clock
from shelfwise.functions.exact import half_up_ratio
from shelfwise.operators import batches, joins
from shelfwise.plans.context import STOCK_VIEW, InventoryContext
from shelfwise.sources import checks, readers, schemas
from tests.conftest import SMALL_SF


def test_half_up_ratio_exact_ties(spark):
    df = spark.createDataFrame(
        [(201, 200), (1, 8), (3, 8), (-1, 8), (2, 3), (5, 0), (None, 4), (1, -8), (-3, -8)],
        "a long, b long")
    got = [r.r for r in df.select(half_up_ratio(F.col("a"), F.col("b"), precision=10).alias("r")).collect()]
    assert got == [Decimal("1.01"), Decimal("0.13"), Decimal("0.38"), Decimal("-0.13"),
                   Decimal("0.67"), None, None, Decimal("-0.13"), Decimal("0.38")]
    pct = df.select(half_up_ratio(F.col("a"), F.col("b"), multiplier=100, precision=12).alias("p"))
    assert pct.first().p == Decimal("100.50")


def test_half_up_ratio_wide_money(spark):
    df = spark.createDataFrame([(Decimal("123456789012345678.99"), Decimal("3.00"))],
                               "a decimal(38,2), b decimal(38,2)")
    r = df.select(half_up_ratio(F.col("a"), F.col("b")).alias("r")).first().r
    assert r == Decimal("41152263004115226.33")


def test_preserving_left_join_matches_plain_left_join(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, name string")
    # key 1 is "hot": most fact rows
    fact = spark.createDataFrame([(1, i) for i in range(50)] + [(3, 99), (None, 7)], "k long, v long")
    got = sorted(map(tuple, joins.preserving_left_join(dim, fact, "k").collect()),
                 key=lambda r: (str(r[0]), str(r[2])))
    want = sorted(map(tuple, dim.join(fact, "k", "left").collect()), key=lambda r: (str(r[0]), str(r[2])))
    assert got == want


def test_sequential_id_is_dense_and_ordered(spark):
    # a leading key holding most rows must still split across partitions
    rows = [(0 if i % 3 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, tie long")
    out = batches.sequential_id(df, ["k", "tie"], start=10000).collect()
    ids = sorted(r.seq_id for r in out)
    assert ids == list(range(10000, 13000))
    by_order = [r.seq_id for r in sorted(out, key=lambda r: (r.k, r.tie))]
    assert by_order == list(range(10000, 13000))


def test_fefo_pick_prefers_earliest_later_expiry(spark):
    d = dt.date(2001, 3, 1)
    sales = spark.createDataFrame(
        [(1, 7, d), (2, 7, d + dt.timedelta(days=10)), (3, 7, d + dt.timedelta(days=40)), (4, 8, d)],
        "sale_id long, medicine_id long, sale_date date")
    pur_rows = [
        (100, 7, d, 5), (101, 7, d + dt.timedelta(days=10), 5), (102, 7, d + dt.timedelta(days=20), 5),
        (103, 7, d + dt.timedelta(days=20), 5), (104, 7, d + dt.timedelta(days=5), 0),
        (105, 7, None, 5),
    ]
    pur = spark.createDataFrame(pur_rows, "purchase_id long, medicine_id long, expiry_date date, "
                                          "quantity_remaining int")
    got = {r.sale_id: (r.purchase_id, r.expiry_date) for r in batches.eligible_batches(sales, pur).collect()}
    assert got == {
        1: (101, d + dt.timedelta(days=10)),   # same-day expiry (100) and empty batch (104) skipped
        2: (102, d + dt.timedelta(days=20)),   # tie on expiry -> lowest purchase id
        3: (None, None),
        4: (None, None),
    }


def test_materialize_and_drop_stock_views(spark):
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    ctx.materialize_stock()
    assert spark.catalog.tableExists(STOCK_VIEW)
    assert spark.table(STOCK_VIEW).count() == ctx.medicines.count()
    dropped = ctx.drop_stock_views()
    assert dropped[STOCK_VIEW] is True and not any(v for k, v in dropped.items() if k != STOCK_VIEW)
    assert not spark.catalog.tableExists(STOCK_VIEW)
    assert ctx.drop_stock_views()[STOCK_VIEW] is False


def test_checkpointed_stock_summary(spark):
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    df = ctx.materialize_stock(checkpoint=True)
    assert df.count() == ctx.medicines.count()
    ctx.drop_stock_views()


def test_required_views_raise(spark):
    with pytest.raises(checks.MissingInputError):
        checks.require_views(spark, "no_such_table_here")


def test_csv_reader_shipped_dialect(spark, tmp_dir):
    path = f"{tmp_dir}/reorder.csv"
    with open(path, "w", newline="") as fh:
        fh.write("medicine_id,min_stock_level,max_stock_level,reorder_quantity,safety_stock_days,"
                 "last_updated\r\n")
        fh.write("1000,37,246,170,7,01-02-2026\r\n1001,12,130,85,5,01-02-2026\r\n")
    df = readers.read_csv_table(spark, path, "reorder_levels")
    rows = df.collect()
    assert [r.min_stock_level for r in rows] == [37, 12]
    assert rows[0].last_updated == dt.date(2026, 2, 1)
    assert df.schema == schemas.REORDER


def test_parquet_round_trip_and_pushdown(spark, tmp_dir):
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    readers.write_parquet(ctx.purchases, f"{tmp_dir}/purchases_transactions.parquet")
    back = readers.read_parquet_table(spark, f"{tmp_dir}/purchases_transactions.parquet",
                                      "purchases_transactions")
    assert back.count() == ctx.purchases.count()
    live = back.where(ctx.clock.after_now(F.col("expiry_date"))).select("medicine_id")
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(expiry_date,2001-03-01)" in plan
    assert "ReadSchema: struct<medicine_id:bigint,expiry_date:date>" in plan


def test_report_run_writes_every_result_from_files(spark, tmp_dir):
    """The whole script over tables read back from Parquet files."""
    from shelfwise.plans import script

    src = InventoryContext.from_driver(spark, SMALL_SF)
    for name in schemas.TABLE_SCHEMAS:
        readers.write_parquet(src.tables[name], f"{tmp_dir}/tables/{name}.parquet")
    ctx = InventoryContext.from_files(spark, f"{tmp_dir}/tables", "parquet", as_of=DEFAULT_AS_OF)
    written = script.run_report(ctx, f"{tmp_dir}/out")
    assert len(written) == 13
    assert not spark.catalog.tableExists(STOCK_VIEW)
    alerts = spark.read.parquet(f"{tmp_dir}/out/low_stock_alert")
    want = src.stock_summary()
    from shelfwise.operators import stock

    assert alerts.count() == stock.low_stock_alert(want, src.reorder).count() == written["low_stock_alert"]
    csv = spark.read.option("header", True).csv(f"{tmp_dir}/out/export_expiry")
    assert csv.count() == spark.read.parquet(f"{tmp_dir}/tables/purchases_transactions.parquet").where(
        "expiry_date > date'2001-03-01' AND quantity_remaining > 0").count()


def test_type_report_lists_declared_types(spark):
    from shelfwise.operators import quality

    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    rep = dict((c, t) for _, c, t in quality.type_report(ctx.purchases, "purchases_transactions"))
    assert rep["purchase_price"] == "decimal(12,2)" and rep["expiry_date"] == "date"
    assert rep["medicine_id"] == "bigint" and rep["quantity_remaining"] == "int"


def test_csv_tables_without_sales_file(spark, tmp_dir):
    """Shipped-dialect CSVs without a sales file: stock reports run, a sales
    report raises a clear missing-input error."""
    from shelfwise.operators import stock

    src = InventoryContext.from_driver(spark, SMALL_SF)
    keep = ("medicines_master", "purchases_transactions", "reorder_levels", "suppliers_master")
    readers.export_tables({t: src.tables[t] for t in keep}, tmp_dir, "csv")
    ctx = InventoryContext.from_files(spark, tmp_dir, "csv", as_of=DEFAULT_AS_OF)
    got = stock.current_stock_summary(ctx.medicines, ctx.purchases, ctx.clock)
    assert got.count() == src.medicines.count()
    assert got.agg(F.sum("current_stock")).first()[0] == src.stock_summary().agg(
        F.sum("current_stock")).first()[0]
    with pytest.raises(checks.MissingInputError):
        ctx.sales
    from shelfwise.plans import script

    with pytest.raises(checks.MissingInputError):
        script.run_report(ctx, f"{tmp_dir}/none")
    written = script.run_report(ctx, f"{tmp_dir}/out", allow_missing=True)
    assert written["sales_movement_top20"] is None and written["executive_kpis"] is None
    assert written["low_stock_alert"] == stock.low_stock_alert(src.stock_summary(), src.reorder).count()
    assert written["table_row_counts"] == 4


def test_checkpoint_dir_never_falls_back_to_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from shelfwise.session import checkpoint_dir

    class Ctx:
        def __init__(self, master, configured=None):
            self.master, self._dir = master, configured

        def getConf(self):
            return SimpleNamespace(get=lambda key, default=None: self._dir or default)

        def getCheckpointDir(self):
            return self._dir

        def setCheckpointDir(self, path):
            self._dir = path

    with pytest.raises(RuntimeError):
        checkpoint_dir(SimpleNamespace(sparkContext=Ctx("yarn")), local_fallback=True)
    shared = SimpleNamespace(sparkContext=Ctx("yarn", "hdfs://nn/checkpoints"))
    assert checkpoint_dir(shared, local_fallback=True) == "hdfs://nn/checkpoints"
    local = SimpleNamespace(sparkContext=Ctx("local[2]"))
    assert checkpoint_dir(local, local_fallback=True)


def test_partitioned_facts_prune_by_clock_and_give_the_same_results(spark, tmp_dir):
    from shelfwise.operators import expiry, stock

    src = InventoryContext.from_driver(spark, SMALL_SF)
    # half a year of expiry days (plus undated batches) keeps the test's directory count small
    pur = src.purchases.where("expiry_date IS NULL OR expiry_date BETWEEN '2001-01-01' AND '2001-06-30'")
    tables = {"purchases_transactions": pur, "medicines_master": src.medicines}
    readers.export_tables(tables, tmp_dir, "parquet", partition_facts=True)
    ctx = InventoryContext.from_files(spark, tmp_dir, "parquet", as_of=DEFAULT_AS_OF)
    alert = expiry.expiry_alert(ctx.purchases, ctx.medicines, ctx.clock)
    plan = alert._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*expiry_date", plan), plan
    want = expiry.expiry_alert(pur, src.medicines, src.clock)
    assert sorted(map(tuple, alert.collect())) == sorted(map(tuple, want.collect()))
    assert ctx.purchases.where("expiry_date IS NULL").count() == pur.where("expiry_date IS NULL").count()
    got = stock.current_stock_summary(ctx.medicines, ctx.purchases, ctx.clock)
    ref = stock.current_stock_summary(src.medicines, pur, src.clock)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ref.collect()))


def test_report_cli_runs_on_exported_csv_tables(spark, tmp_dir):
    import os
    import subprocess
    import sys

    src = InventoryContext.from_driver(spark, SMALL_SF)
    readers.export_tables(src.tables, f"{tmp_dir}/tables", "csv")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    res = subprocess.run(
        [sys.executable, "-m", "shelfwise.plans.script", "--tables", f"{tmp_dir}/tables",
         "--fmt", "csv", "--out", f"{tmp_dir}/out", "--master", "local[2]", "--as-of", "2001-03-01T12:00"],
        cwd=root, capture_output=True, text=True, timeout=600,
        env={**os.environ, "SPARK_LOCAL_IP": "127.0.0.1"},
    )
    assert res.returncode == 0, res.stderr[-2000:]
    lines = [ln for ln in res.stdout.splitlines() if ": " in ln]
    assert len(lines) == 13 and "low_stock_alert: 49 rows" in res.stdout


def test_sequential_id_on_a_wide_table(spark):
    """Two million rows, eight ranges and a column beside the order key."""
    n = 2_000_000
    df = spark.range(n).select((F.col("id") % 1000).alias("k"), F.col("id").alias("tie"), F.sha1(F.col("id").cast("string")).alias("x"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        out = batches.sequential_id(df, ["k", "tie"])
        got = out.agg(F.count("*"), F.countDistinct("seq_id"), F.min("seq_id"), F.max("seq_id")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(got) == (n, n, 1, n)


def _reorder_csv(path, header):
    with open(path, "w", newline="") as fh:
        fh.write(header + "\r\n1000,37,246,170,7,01-02-2026\r\n")


@pytest.mark.parametrize("header", [
    "medicine_id,max_stock_level,min_stock_level,reorder_quantity,safety_stock_days,last_updated",
    "medicine_id,minimum,max_stock_level,reorder_quantity,safety_stock_days,last_updated"])
def test_csv_with_another_header_is_refused(spark, tmp_dir, header):
    _reorder_csv(f"{tmp_dir}/reorder.csv", header)
    with pytest.raises(Exception, match="CSV header"):
        readers.read_csv_table(spark, f"{tmp_dir}/reorder.csv", "reorder_levels").collect()


def test_parquet_without_a_needed_column_is_refused(spark, tmp_dir):
    src = InventoryContext.from_driver(spark, SMALL_SF)
    src.purchases.withColumnRenamed("expiry_date", "expiry").write.parquet(f"{tmp_dir}/p.parquet")
    with pytest.raises(checks.MissingInputError, match="expiry_date"):
        readers.read_parquet_table(spark, f"{tmp_dir}/p.parquet", "purchases_transactions")


def test_runs_read_the_time_and_registered_queries_a_pinned_clock(spark):
    before = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    ctx = InventoryContext(spark, {})
    assert dt.timedelta(0) <= ctx.clock.as_of - before < dt.timedelta(minutes=5)
    assert InventoryContext.from_driver(spark, SMALL_SF).clock == Clock.at(DEFAULT_AS_OF)


def test_forecast_of_an_endless_cover_has_no_date(spark):
    from shelfwise.operators import planning

    day = DEFAULT_AS_OF.date()
    med = spark.createDataFrame([(1,)], "medicine_id long")
    sold = spark.createDataFrame([(1, 1, day)], "medicine_id long, quantity_sold int, sale_date date")
    pur = spark.createDataFrame([(1, 1, 2_000_000_000, day + dt.timedelta(days=90))],
                                "medicine_id long, supplier_id long, quantity_remaining int, expiry_date date")
    sup = spark.createDataFrame([(1, 3)], "supplier_id long, lead_time_days int")
    rule = spark.createDataFrame([(1, 5)], "medicine_id long, safety_stock_days int")
    row = planning.stockout_forecast(med, sold, pur, sup, rule, Clock.at(DEFAULT_AS_OF)).first()
    assert row.cover_days == 60_000_000_000 and row.stockout_date is None and row.reorder_alert == "NO"


def test_result_order(spark):
    """Rows come in the order of the report: S1, S2, S3, S5, S6."""
    from shelfwise.plans import registry

    q = registry.all_queries()
    keys = {
        "current_stock_summary": lambda r: -r.current_stock,
        "low_stock_alert": lambda r: (r.alert_priority, r.current_stock),
        "expiry_alert": lambda r: (r.expiry_date, -r.quantity_remaining),
        "stock_by_name": lambda r: r.current_stock,
        "export_stock_status": lambda r: r.medicine_name,
        "category_valuation": lambda r: -r.total_investment,
        "supplier_performance": lambda r: (r.percentage_expiring_soon, -r.total_purchase_value),
    }
    for name, key in keys.items():
        got = [key(r) for r in q[name](spark, SMALL_SF).collect()]
        assert got == sorted(got) and len(got) > 1, name


def test_catalog_of_many_entries_is_flattened(spark):
    nested = spark.createDataFrame(
        [({"a": [("x", 1), ("y", 2)], "b": [("z", 3)]},), ({"a": [("w", 4)]},), ({},)],
        "catalog map<string, array<struct<name: string, pack: bigint>>>")
    got = sorted(map(tuple, batches.flatten_catalog(nested).collect()))
    assert got == [("a", "w", 4), ("a", "x", 1), ("a", "y", 2), ("b", "z", 3)]


def test_catalogs_of_a_hot_manufacturer_are_bounded(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") < 29_000, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("manufacturer"),
        F.concat(F.lit("c"), F.col("id") % 5).alias("category"),
        F.concat(F.lit("n"), F.col("id") % 1000).alias("medicine_name"), F.col("id").alias("medicine_id"))
    nested = batches.nest_catalog(df.repartition(2, "manufacturer"))
    sizes = [(len(r.catalog), sum(map(len, r.catalog.values()))) for r in nested.collect()]
    assert max(n for _, n in sizes) <= 10_000 and max(c for c, _ in sizes) == 5
    got = sorted(map(tuple, batches.flatten_catalog(nested).collect()))
    assert got == sorted(map(tuple, df.select("category", "medicine_name", "medicine_id").collect()))
