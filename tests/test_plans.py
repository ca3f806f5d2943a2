"""Physical-plan properties that matter at scale."""

import re

import pytest

from shelfwise.plans import registry
from tests.conftest import SMALL_SF

QUERIES = registry.all_queries()
STREAMING = {"stock_movement_windows", "closed_movement_windows", "low_stock_stream_alert"}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {k: physical(q(spark, SMALL_SF)) for k, q in QUERIES.items() if k not in STREAMING}


def test_no_python_udfs_anywhere(plans):
    for name, plan in plans.items():
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_no_cartesian_products(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name


def test_nested_loop_joins_only_against_single_row_frames(plans):
    # BroadcastNestedLoopJoin appears only for cross joins with 1-row aggregates
    for name, plan in plans.items():
        for m in re.finditer(r"BroadcastNestedLoopJoin (\w+), (\w+)", plan):
            assert m.group(2) == "Cross", (name, m.group(0))


def test_executive_kpis_reads_each_source_once(plans):
    plan = plans["executive_kpis"]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    lineitem_scans = [s for s in scans if "l_orderkey" in s or "l_partkey" in s]
    # one scan for purchases, one for sales (both derive from lineitem in the adapters)
    assert len(lineitem_scans) == 2, scans
    orders_scans = [s for s in scans if "o_orderkey" in s]
    assert len(orders_scans) == 1


def test_fefo_pick_forms_no_range_join(plans):
    plan = plans["eligible_batches"]
    assert "BroadcastNestedLoopJoin" not in plan
    # the only windows are per item
    assert "Window [last(" in plan


def test_row_counts_come_from_the_footers(plans):
    scans = re.findall(r"BatchScan parquet .*", plans["table_row_counts"])
    plain = [x for x in scans if "part.parquet" in x or ("lineitem.parquet" in x and "count(*)" in x)]
    assert len(plain) == 3 and all("PushedAggregation: [COUNT(*)]" in x for x in plain), scans


def test_profiles_of_plain_tables_come_from_the_footers(spark, tmp_dir):
    from shelfwise.operators import quality
    from shelfwise.plans.context import InventoryContext
    from shelfwise.sources import readers

    source = InventoryContext.from_driver(spark, SMALL_SF)
    readers.export_tables(source.tables, tmp_dir, "parquet")
    ctx = InventoryContext.from_files(spark, tmp_dir, "parquet", as_of="2001-03-01T12:00")
    tables = ctx.footer_tables()
    ranges = quality.date_range_profile(tables["purchases_transactions"], tables["sales_transactions"])
    plan = physical(ranges)
    assert len(re.findall(r"PushedAggregation: \[MIN\(", plan)) == 2
    assert set(map(tuple, ranges.collect())) == set(map(tuple, quality.date_range_profile(source.purchases, source.sales).collect()))
    nulls = quality.null_profile(tables["reorder_levels"], "reorder_levels")
    assert "PushedAggregation: [COUNT(*), COUNT(" in physical(nulls)
    assert set(map(tuple, nulls.collect())) == set(map(tuple, quality.null_profile(source.reorder, "reorder_levels").collect()))


BY_EXPIRY = ["current_stock_summary", "expiry_alert", "total_investment", "category_valuation", "executive_kpis",
             "export_stock_status", "export_expiry", "stock_by_name", "expiry_band_distribution", "drilldown_rollup"]


@pytest.mark.parametrize("name", BY_EXPIRY)
def test_expiry_bound_reaches_the_scan(plans, name):
    """The scan of the purchases is pruned by date, and only the dated branch is left."""
    scans = [x for x in re.findall(r"FileScan parquet .*", plans[name]) if "l_shipdate" in x]
    assert scans and all("GreaterThanOrEqual(l_shipdate,2001-03-02T00:00)" in x for x in scans), scans


def test_all_purchases_are_read_once_without_an_expiry_bound(plans):
    assert len(re.findall(r"FileScan parquet", plans["quantity_reconciliation"])) == 1


@pytest.mark.parametrize("name", ["category_valuation", "supplier_performance", "supplier_order_history", "agg_multi_distinct"])
def test_distinct_counts_copy_no_input_rows(plans, name):
    assert "Expand" not in plans[name]


@pytest.mark.parametrize("name", ["category_valuation", "agg_multi_distinct"])
def test_distinct_counts_read_the_purchases_once(plans, name):
    assert len([x for x in re.findall(r"FileScan parquet .*", plans[name]) if "l_partkey" in x]) == 1


def test_supplier_names_stay_out_of_the_shuffle_of_the_purchases(plans):
    plan = plans["supplier_performance"].splitlines()
    at = [i for i, x in enumerate(plan) if "FileScan" in x and "l_suppkey" in x]
    assert at
    for i in at:  # up from each scan of the fact, the first aggregate has no supplier name
        above = next(x for x in reversed(plan[:i]) if "HashAggregate" in x or "SortAggregate" in x)
        assert "s_name" not in above and "supplier_name" not in above


def test_top20_uses_take_ordered(plans):
    assert "TakeOrderedAndProject" in plans["sales_movement_top20"]


def test_sequential_id_has_no_global_window_over_rows(plans):
    plan = plans["sequential_id"]
    assert "Scan ExistingRDD" in plan  # both branches read the checkpointed, numbered rows
    # the only global (unpartitioned) window is over the per-partition counts
    windows = re.findall(r"Window \[[^\]]*\], \[\]", plan)
    assert len(windows) <= 1
