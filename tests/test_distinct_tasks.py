"""Distinct counts get as many tasks as their rows need."""

from __future__ import annotations

import re

from shelfwise.operators import blocks, distinct


def test_tasks_of_distinct_counts_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(distinct, "ROWS_PER_TASK", 4)
    rows = [(i % 3 or None, i % 5, f"B{i % 7}" if i % 4 else None) for i in range(40)] * 2
    df = spark.createDataFrame(rows, "supplier_id long, medicine_id long, batch_no string")
    got = blocks.agg_multi_distinct(df)
    expected = {(s, len({m for t, m, _ in rows if t == s}), len({b for t, _, b in rows if t == s and b is not None})) for s in (None, 1, 2)}
    assert {tuple(r) for r in got.collect()} == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert {"20", "40"} <= set(re.findall(r"hashpartitioning\([^\n]*?, (\d+)\), REPARTITION_BY_NUM", plan))
    assert blocks.agg_multi_distinct(df.limit(0)).count() == 0
