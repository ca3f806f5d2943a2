"""Several exact distinct counts next to sums, from one scan and without
rewriting every input row once per count.

The planner's rewrite of ``COUNT(DISTINCT a), COUNT(DISTINCT b), SUM(x)``
copies each *input* row once per distinct column before the first shuffle.
Here the caller first reduces the input by all counted columns (a map-side
combining aggregate); only those reduced rows are dealt into one row per
counted column (``one_row_per_value``), the sums travelling with the first;
a second aggregate makes the values distinct, and ``counted`` counts them.

No step gathers the values of a group: a hot group's values are spread by the
second aggregate's key, and the last one receives one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIND = "_kind"
ROWS_PER_TASK = 1 << 18


def _typed_null(df: DataFrame, name: str) -> Column:
    return F.lit(None).cast(df.schema[name].dataType)


def _dealt(reduced: DataFrame, keys: list[str], values: list[str], sums: list[str]) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(i).alias(KIND), *[F.col(k) for k in keys],
            *[(F.col(v) if v == value else _typed_null(reduced, v)).alias(v) for v in values],
            *[(F.col(s) if i == 0 else _typed_null(reduced, s)).alias(s) for s in sums],
        )
        for i, value in enumerate(values)
    ])
    return reduced.select(F.inline(rows))


def one_row_per_value(reduced: DataFrame, keys: list[str], values: list[str], sums: list[str]) -> DataFrame:
    """(kind, keys, values, sums): for kind i only ``values[i]`` is set, each
    distinct value of a group is one row, and the sums are those of kind 0."""
    dealt = _dealt(reduced, keys, values, sums)
    if not sums:
        return dealt.distinct()
    return dealt.groupBy(KIND, *keys, *values).agg(
        *[F.sum(s).cast(reduced.schema[s].dataType).alias(s) for s in sums])


def counted(distinct: DataFrame, keys: list[str], values: dict[str, str], sums: list[str]) -> DataFrame:
    """One row per group of ``keys``: distinct non-NULL values (``values``:
    column -> name of its count, in the order of the kinds) and total sums."""
    return distinct.groupBy(*keys).agg(
        *[F.count(F.when(F.col(KIND) == i, F.col(v))).alias(name) for i, (v, name) in enumerate(values.items())],
        *[F.sum(s).cast(distinct.schema[s].dataType).alias(s) for s in sums],
    )


def spread_counts(df: DataFrame, keys: list[str], values: dict[str, str], rows: int) -> DataFrame:
    """``distinct_counts`` of an input of about ``rows`` rows that may hold about as many
    distinct ones: both distinct steps get as many tasks as the rows need, so that the hash
    tables of a task hold about ``ROWS_PER_TASK`` entries at any size of the input."""
    tasks = max(1, -(-rows // ROWS_PER_TASK))
    reduced = df.select(*keys, *values).repartition(tasks, *keys, *values).distinct()
    dealt = _dealt(reduced, keys, list(values), []).repartition(tasks * len(values), KIND, *keys, *values)
    return counted(dealt.distinct(), keys, values, [])


def distinct_counts(reduced: DataFrame, keys: list[str], values: dict[str, str], sums: list[str] = ()) -> DataFrame:
    """Both steps: ``keys``, a count per entry of ``values``, and the sums."""
    sums = list(sums)
    return counted(one_row_per_value(reduced, keys, list(values), sums), keys, values, sums)
