"""The reference's end-to-end report run, as one Spark job sequence.

Order as in the reference: row counts; the stock summary materialized once
(so the low-stock, emergency and KPI reports read one snapshot with one
clock); expiry alert; valuation; sales movement; supplier performance; KPI
board; clean-up; exports; KPI union; stock by name. Each result is written by
the executors to ``out_dir/<name>`` (Parquet, or CSV with a header for the
spreadsheet exports); nothing is collected on the driver.

usage: python -m shelfwise.plans.script --tables DIR --fmt csv|parquet --out DIR
                                        [--as-of 2026-02-17T12:00] [--master local[4]]
                                        [--allow-missing]
(under spark-submit the master comes from the submit command)
"""

from __future__ import annotations

import argparse

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import expiry, kpi, sales, stock, suppliers, valuation
from shelfwise.plans.context import STOCK_VIEW, InventoryContext
from shelfwise.session import build_session, subdir
from shelfwise.sources import readers
from shelfwise.sources.checks import MissingInputError, require_views

CSV_EXPORTS = ("export_stock_status", "export_expiry")


def report_frames(ctx: InventoryContext, allow_missing: bool = False) -> dict[str, Callable[[], DataFrame]]:
    """The script's result sets, in order, each built on demand over one
    materialized stock summary."""
    c = ctx.clock

    def summary() -> DataFrame:
        if not ctx.spark.catalog.tableExists(STOCK_VIEW):
            ctx.materialize_stock()
        require_views(ctx.spark, STOCK_VIEW)  # the sections below read the one snapshot
        return ctx.stock_summary()

    return {
        "table_row_counts": lambda: kpi.table_row_counts(
            {t: ctx.tables[t] for t in ctx.tables if not allow_missing or _present(ctx, t)}),
        "current_stock_summary": lambda: stock.stock_summary_report(summary()),
        "low_stock_alert": lambda: stock.low_stock_alert(summary(), ctx.reorder),
        "expiry_alert": lambda: expiry.expiry_alert(ctx.purchases_by_expiry, ctx.medicines, c),
        "category_valuation": lambda: valuation.category_valuation(ctx.purchases_by_expiry, ctx.medicines, c),
        "emergency_status": lambda: stock.emergency_status(summary(), ctx.reorder),
        "sales_movement_top20": lambda: sales.sales_movement_top(ctx.sales, ctx.medicines, c),
        "supplier_performance": lambda: suppliers.supplier_performance(ctx.suppliers, ctx.purchases, c),
        "executive_kpis": lambda: kpi.executive_kpis(
            ctx.medicines, ctx.purchases_by_expiry, ctx.sales, ctx.reorder, c),
        "export_stock_status": lambda: stock.export_stock_status(
            ctx.medicines, ctx.purchases_by_expiry, ctx.reorder, c),
        "export_expiry": lambda: expiry.export_expiry(ctx.purchases_by_expiry, ctx.medicines, c),
        "kpi_union": lambda: kpi.kpi_union(ctx.medicines, ctx.reorder, ctx.purchases, c),
        "stock_by_name": lambda: stock.stock_by_name(ctx.medicines, ctx.purchases_by_expiry, ctx.reorder, c),
    }


def _present(ctx: InventoryContext, table: str) -> bool:
    try:
        ctx.tables[table]
        return True
    except MissingInputError:
        return False


def run_report(ctx: InventoryContext, out_dir: str, allow_missing: bool = False) -> dict[str, int | None]:
    """Write every result set under ``out_dir``.

    Returns rows written per result (the reference's "rows returned"
    messages), taken from ``observe`` metrics gathered by the write itself,
    so no second job counts the rows. A missing table or column stops the
    run; with ``allow_missing`` its sections are skipped and marked ``None``.
    """
    written: dict[str, int | None] = {}
    try:
        for name, build in report_frames(ctx, allow_missing).items():
            try:
                df = build()
            except MissingInputError:
                if not allow_missing:
                    raise
                written[name] = None
                continue
            path = subdir(out_dir, name)
            obs = Observation(name)
            observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
            if name in CSV_EXPORTS:
                readers.write_csv(observed, path)
            else:
                readers.write_parquet(observed, path)
            written[name] = int(obs.get["rows"])
    finally:
        ctx.drop_stock_views()  # the clean-up step, also on failure
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    ap.add_argument("--tables", required=True, help="folder with <table>.csv or <table>.parquet")
    ap.add_argument("--fmt", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--out", required=True)
    ap.add_argument("--as-of", default=None, help="ISO timestamp; default: now (UTC)")
    ap.add_argument("--allow-missing", action="store_true",
                    help="skip sections whose tables are missing (exit code 3)")
    ap.add_argument("--master", default=None, help="Spark master when not run by spark-submit")
    args = ap.parse_args(argv)
    spark: SparkSession = build_session(args.master)
    ctx = InventoryContext.from_files(spark, args.tables, args.fmt, as_of=args.as_of)
    written = run_report(ctx, args.out, args.allow_missing)
    for name, rows in written.items():
        print(f"{name}: " + ("skipped (missing input)" if rows is None else f"{rows} rows"))
    if None in written.values():
        raise SystemExit(3)


if __name__ == "__main__":
    main()
