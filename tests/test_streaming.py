"""Streaming results equal the batch query on the same rows, over several
micro-batches (events split across files, one file per trigger)."""

import uuid

from pyspark.sql import functions as F

from shelfwise.plans.context import InventoryContext
from shelfwise.session import checkpoint_dir, subdir
from shelfwise.sources import adapters
from shelfwise.streaming import movements
from tests.conftest import SMALL_SF


def _split_events(spark, tmp_dir, parts=3):
    events = spark.read.parquet(f"{SMALL_SF}/events.parquet")
    src = f"{tmp_dir}/events"
    events.withColumn("_p", F.pmod(F.col("event_id"), F.lit(parts))).repartition(parts, "_p").drop(
        "_p").write.parquet(src)
    return events, src


def _sorted(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_windows_over_micro_batches_equal_batch(spark, tmp_dir):
    events, src = _split_events(spark, tmp_dir)
    run = subdir(checkpoint_dir(spark), f"t1-{uuid.uuid4().hex}")
    stream = movements.stock_movement_windows(
        movements.movements(movements.read_event_stream(spark, src, max_files_per_trigger=1)),
        watermark="400 days",  # nothing is late in this replay
    )
    q = movements.write_changelog(stream, subdir(run, "out"), subdir(run, "ckpt"))
    q.awaitTermination()
    assert q.lastProgress is not None and q.lastProgress["batchId"] >= 2
    got = movements.latest_per_key(spark.read.parquet(subdir(run, "out")),
                                   ["window_start", "window_end", "medicine_id"])
    moves = adapters.stock_movements(events)
    want = moves.groupBy(F.window("ts", "1 day").alias("w"), "medicine_id").agg(
        F.sum("units").cast("bigint").alias("units"), F.count(F.lit(1)).alias("movements")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "medicine_id", "units",
             "movements")
    cols = ["window_start", "medicine_id", "units", "movements"]
    assert _sorted(got, cols) == _sorted(want, cols)


def test_running_stock_alert_over_micro_batches_equals_batch(spark, tmp_dir):
    events, src = _split_events(spark, tmp_dir)
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    run = subdir(checkpoint_dir(spark), f"t2-{uuid.uuid4().hex}")
    stream = movements.running_stock(
        movements.movements(movements.read_event_stream(spark, src, max_files_per_trigger=1)))
    q = movements.write_changelog(stream, subdir(run, "out"), subdir(run, "ckpt"),
                                  transform=lambda b: movements.label_stock(b, ctx.medicines, ctx.reorder))
    q.awaitTermination()
    changelog = spark.read.parquet(subdir(run, "out"))
    assert changelog.select("_batch_id").distinct().count() >= 2
    got = movements.latest_per_key(changelog, ["medicine_id"])
    batch = movements.label_stock(
        movements.running_stock(adapters.stock_movements(events)), ctx.medicines, ctx.reorder)
    cols = ["medicine_id", "running_stock", "movements", "stock_status", "low_stock_alert",
            "alert_priority"]
    assert _sorted(got, cols) == _sorted(batch, cols)


def test_rows_later_than_the_watermark_are_dropped(spark, tmp_dir):
    """Late rows are judged against the watermark of the previous micro-batch
    (Spark advances it after each batch), so the late file is the third one."""
    import datetime as dt
    import glob
    import os
    import time

    src = f"{tmp_dir}/late_events"
    schema = movements.EVENT_SCHEMA
    files = {
        "a": [(i, dt.datetime(2024, 1, 10, 8, i), 7, "signup", 1.0, None) for i in range(3)],
        "b": [(10, dt.datetime(2024, 1, 10, 9, 0), 7, "signup", 1.0, None)],
        "c": [(99, dt.datetime(2024, 1, 1, 9, 0), 7, "signup", 1.0, None),      # 9 days behind
              (98, dt.datetime(2024, 1, 9, 20, 0), 7, "purchase", 1.0, None)],  # inside the 1-day grace
    }
    now = time.time()
    for i, (sub, rows) in enumerate(files.items()):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{sub}")
        for f in glob.glob(f"{src}/{sub}/*.parquet"):  # arrival order = modification time
            os.utime(f, (now - 300 + 100 * i, now - 300 + 100 * i))
    run = subdir(checkpoint_dir(spark), f"late-{uuid.uuid4().hex}")
    stream = movements.stock_movement_windows(movements.movements(
        movements.read_event_stream(spark, f"{src}/*", max_files_per_trigger=1)))
    q = movements.write_changelog(stream, subdir(run, "out"), subdir(run, "ckpt"))
    q.awaitTermination()
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress
                  for s in p["stateOperators"])
    got = {(r.window_start.day, r.units) for r in movements.latest_per_key(
        spark.read.parquet(subdir(run, "out")), ["window_start", "window_end", "medicine_id"]
    ).collect()}
    assert got == {(10, 16), (9, -3)} and dropped == 1


def _want_windows(spark):
    moves = adapters.stock_movements(spark.read.parquet(f"{SMALL_SF}/events.parquet"))
    rows = moves.groupBy(F.window("ts", "1 day").alias("w"), "medicine_id").agg(
        F.sum("units").cast("bigint").alias("units"), F.count(F.lit(1)).alias("movements")
    ).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
             F.col("w.end").cast("timestamp_ntz").alias("window_end"), "medicine_id", "units", "movements")
    return {tuple(r) for r in rows.collect()}, moves.agg(F.max("ts").cast("timestamp_ntz")).first()[0]


def test_append_mode_writes_closed_windows_once_and_keeps_open_ones_in_state(spark, tmp_dir):
    import datetime as dt

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _, src = _split_events(spark, tmp_dir)
    run = subdir(checkpoint_dir(spark), f"t1a-{uuid.uuid4().hex}")
    windows = movements.stock_movement_windows(
        movements.movements(movements.read_event_stream(spark, src, max_files_per_trigger=1)), watermark="400 days")
    out = movements.BatchFolders(spark, subdir(run, "closed"), windows.schema)
    movements.write_closed_windows(windows, out, subdir(run, "ckpt")).awaitTermination()
    want, newest = _want_windows(spark)
    assert out.read().count() == 0  # nothing is older than 400 days, so no window has closed
    opened = movements.open_windows(spark, subdir(run, "ckpt"))
    assert {tuple(r) for r in opened.collect()} == want

    got = [tuple(r) for r in movements.run_closed_windows(spark, movements.event_glob(SMALL_SF)).collect()]
    closed = {w for w in want if w[1] <= newest - dt.timedelta(days=1)}
    assert len(got) == len(closed) and set(got) == closed and closed != want
    everything = [tuple(r) for r in movements.run_movement_windows(spark, movements.event_glob(SMALL_SF)).collect()]
    assert len(everything) == len(want) and set(everything) == want


def test_replayed_batch_of_closed_windows_changes_nothing(spark):
    out = movements.BatchFolders(spark, subdir(checkpoint_dir(spark), f"bf-{uuid.uuid4().hex}"),
                                 spark.createDataFrame([], "k int, v int").schema)
    one, two = (spark.createDataFrame(rows, "k int, v int") for rows in ([(1, 1), (2, 2)], [(3, 3)]))
    for batch, i in ((one, 0), (two, 1), (one, 0), (two, 1)):
        out.write(batch, i)
        assert not any("_temporary" in f for f in out.read().inputFiles())
    assert _sorted(out.read(), ["k", "v"]) == [(1, 1), (2, 2), (3, 3)]


def test_streams_over_no_rows_give_no_rows(spark, tmp_dir):
    src = f"{tmp_dir}/none"
    spark.createDataFrame([], movements.EVENT_SCHEMA).write.parquet(src)
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    assert movements.run_movement_windows(spark, src).count() == 0
    assert movements.run_closed_windows(spark, src).count() == 0
    assert movements.run_low_stock_alert(spark, src, ctx.medicines, ctx.reorder).count() == 0


def _snapshot(spark, merge_every):
    folder = subdir(checkpoint_dir(spark), f"ks-{uuid.uuid4().hex}")
    schema = spark.createDataFrame([], "k int, v int").schema
    return folder, movements.KeyedSnapshot(spark, folder, schema, ["k"], merge_every)


def test_snapshot_stays_bounded_over_a_hundred_batches(spark):
    from shelfwise.streaming import sinks

    folder, snap = _snapshot(spark, 10)
    want, most = {}, 0
    for b in range(100):
        rows = [(k, 1000 * b + k) for k in range(b % 7, 40, 7)] + [(None, b)]
        want.update(rows)
        snap.apply(spark.createDataFrame(rows, "k int, v int").coalesce(1), b)
        if b % 9 == 0:
            most = max(most, len(snap._rows(None).inputFiles()))
            assert dict(tuple(r) for r in snap.read().collect()) == want
    assert dict(tuple(r) for r in snap.read().collect()) == want
    assert most <= 4 + 10 * 2  # files of one snapshot, and of fewer than 10 deltas
    assert len(sinks._numbers(spark, subdir(folder, "deltas"))) <= 20
    assert len(sinks._numbers(spark, subdir(folder, "snapshot"))) == 2
    assert [tuple(r) for r in snap.read(F.col("k") == 5).collect()] == [(5, want[5])]


def test_kill_between_merge_and_switch_loses_nothing(spark):
    folder, snap = _snapshot(spark, 3)
    frames = [spark.createDataFrame([(b, b), (99, b)], "k int, v int").coalesce(1) for b in range(8)]
    for b in range(2):
        snap.apply(frames[b], b)

    def killed(version):
        raise RuntimeError("killed")

    snap._switch, real = killed, snap._switch
    try:
        snap.apply(frames[2], 2)  # batch_id - version reaches 3: snapshot 2 is written, then the run dies
        raise AssertionError("the switch was not reached")
    except RuntimeError:
        pass
    want = {0: 0, 1: 1, 2: 2, 99: 2}
    again = movements.KeyedSnapshot(spark, folder, snap.schema, ["k"], 3)  # a new driver
    assert again.versions() == [-1] and dict(tuple(r) for r in again.read().collect()) == want
    again.apply(frames[2], 2)  # the stream replays the batch
    assert again.versions()[-1] == 2 and dict(tuple(r) for r in again.read().collect()) == want
    again.apply(frames[2], 2)  # and once more, after the switch
    for b in range(3, 8):
        again.apply(frames[b], b)
    assert dict(tuple(r) for r in again.read().collect()) == {**{b: b for b in range(8)}, 99: 7}
    snap._switch = real


def test_alert_snapshot_over_micro_batches_equals_batch(spark, tmp_dir):
    events, src = _split_events(spark, tmp_dir, parts=5)
    ctx = InventoryContext.from_driver(spark, SMALL_SF)
    run = subdir(checkpoint_dir(spark), f"t2s-{uuid.uuid4().hex}")
    stock = movements.running_stock(movements.movements(movements.read_event_stream(spark, src, max_files_per_trigger=1)))
    batch = movements.label_stock(movements.running_stock(adapters.stock_movements(events)), ctx.medicines, ctx.reorder)
    snap = movements.KeyedSnapshot(spark, subdir(run, "items"), batch.schema, ["medicine_id"], merge_every=2)
    movements.write_alert_snapshot(stock, snap, subdir(run, "ckpt"),
                                   lambda b: movements.label_stock(b, ctx.medicines, ctx.reorder)).awaitTermination()
    assert snap.versions()[-1] >= 3
    assert sorted(map(tuple, snap.read().select(*batch.columns).collect()), key=repr) == sorted(map(tuple, batch.collect()), key=repr)
