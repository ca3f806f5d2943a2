"""Required-input checks (the script's existence guards), made to stop the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.sources.schemas import TABLE_SCHEMAS


class MissingInputError(RuntimeError):
    pass


def require_views(spark: SparkSession, *names: str) -> None:
    """Raise unless every named table or view is registered in the catalog."""
    missing = [n for n in names if not spark.catalog.tableExists(n)]
    if missing:
        raise MissingInputError(f"required table(s) not found: {', '.join(missing)}")


def require_columns(df: DataFrame, table: str, columns: list[str] | None = None) -> None:
    """Raise unless ``df`` carries the named (default: all declared) columns."""
    wanted = columns or [f.name for f in TABLE_SCHEMAS[table].fields]
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise MissingInputError(f"{table} lacks column(s): {', '.join(missing)}")
