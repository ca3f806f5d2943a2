"""shelfwise: perishable-stock inventory analytics on Spark DataFrames.

Layout
------
sources/    schemas, readers/writers, driver-table adapters, input checks
functions/  the clock, business-rule ladders and exact ratios as Columns
operators/  the queries (stock, expiry, valuation, sales, suppliers, kpi, ...)
plans/      the run context (one clock, one cached stock summary), the
            query registry and the DuckDB oracle SQL
streaming/  Structured Streaming stock-movement windows and alerts
"""

from shelfwise.session import build_session, checkpoint_dir  # noqa: F401

__all__ = ["build_session", "checkpoint_dir"]
