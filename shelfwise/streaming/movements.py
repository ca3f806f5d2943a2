"""Structured Streaming stock movements (T1) and low-stock alerts.

Source: a file stream (Parquet files arriving in a folder, or a glob) of
raw events, mapped to signed stock movements by the same adapter as batch.

T1 ``stock_movement_windows``: units per item per tumbling window, with a
watermark so that state for closed windows is dropped and rows later than
the watermark are ignored (Spark judges lateness against the watermark
reached at the end of the previous micro-batch). In append mode a window
comes out once, when the watermark has passed its end, and is final:
``write_closed_windows`` puts each batch's windows into a folder of their own.
Windows that are still open are no output; ``open_windows`` reads them from
the state store of the checkpoint, so "closed and open" is the result so far.

T2 ``running_stock``: units per item since the stream began (state is one
row per item, bounded by the item count); each micro-batch's updated items
are labelled against the *static* reorder rules and items inside
``foreachBatch`` (a batch join of the changed rows only; AQE broadcasts the
changed rows when they are small). For a continuously running stream with
frequent micro-batches, pass persisted two-column projections of the items
and rules to ``label_stock`` so each batch does not re-read them. The latest
labels of all items are a ``KeyedSnapshot`` (see ``sinks``): a read takes one
snapshot and a bounded number of deltas, however many batches there were.

``write_changelog`` is the plain sink for consumers that want every change: it
appends every micro-batch's updated rows, tagged with the batch id; a replayed
batch writes identical rows under the same id, so ``latest_per_key`` is
unaffected. It keeps growing and is not read by the two queries.

Checkpoints and output live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfwise.functions import rules
from shelfwise.session import checkpoint_dir, subdir
from shelfwise.sources import adapters
from shelfwise.streaming.sinks import MERGE_EVERY, BatchFolders, KeyedSnapshot, latest_per_key

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

WINDOW = "1 day"
WATERMARK = "1 day"


def read_event_stream(spark: SparkSession, path: str,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def movements(events: DataFrame) -> DataFrame:
    return adapters.stock_movements(events)


def stock_movement_windows(moves: DataFrame, window: str = WINDOW,
                           watermark: str = WATERMARK) -> DataFrame:
    """Units and movement count per item per tumbling window."""
    w = F.window("ts", window)
    return (
        moves.withWatermark("ts", watermark)
        .groupBy(w.alias("w"), "medicine_id")
        .agg(F.sum("units").cast("bigint").alias("units"),
             F.count(F.lit(1)).cast("bigint").alias("movements"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "medicine_id", "units", "movements",
        )
    )


def running_stock(moves: DataFrame) -> DataFrame:
    """T2 state: running units per item (opening stock 0)."""
    return moves.groupBy("medicine_id").agg(
        F.sum("units").cast("bigint").alias("running_stock"),
        F.count(F.lit(1)).cast("bigint").alias("movements"),
    )


def label_stock(stock: DataFrame, medicines: DataFrame, reorder: DataFrame) -> DataFrame:
    """Status band (R1), alert flag (R6) and priority (R4) for running stock rows."""
    j = stock.join(reorder.select("medicine_id", "min_stock_level"), "medicine_id", "left").join(
        medicines.select("medicine_id", "is_emergency"), "medicine_id", "left"
    )
    s, mn = F.col("running_stock"), F.col("min_stock_level")
    emerg = F.coalesce(F.col("is_emergency"), F.lit(0))
    return j.select(
        "medicine_id", "running_stock", "movements", "min_stock_level",
        rules.stock_status(s).alias("stock_status"),
        F.when(rules.is_low_stock_alert(s, mn, emerg), "YES").otherwise("NO").alias("low_stock_alert"),
        rules.alert_priority(s, mn, emerg).alias("alert_priority"),
    )


def write_changelog(stream: DataFrame, out_path: str, checkpoint: str,
                    transform=None, available_now: bool = True,
                    processing_time: str | None = None) -> StreamingQuery:
    """Run ``stream`` in update mode, appending each micro-batch to ``out_path``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform is not None else batch
        rows.withColumn("_batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(
            out_path
        )

    writer = (
        stream.writeStream.outputMode("update")
        .foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


WINDOW_KEYS = ["window_start", "window_end", "medicine_id"]


def _trigger(writer, available_now: bool, processing_time: str | None):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=processing_time) if processing_time else writer


def write_closed_windows(windows: DataFrame, out: BatchFolders, checkpoint: str,
                         available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """T1 in append mode: every window is written once, when it has closed."""
    writer = windows.writeStream.outputMode("append").foreachBatch(out.write).option(
        "checkpointLocation", checkpoint)
    return _trigger(writer, available_now, processing_time).start()


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that have not closed yet, as of the last micro-batch, from
    the state store (a batch read; the stream need not run)."""
    state = utc_session(spark).read.format("statestore").load(checkpoint)
    w = F.col("key.window")
    return state.select(
        w["start"].cast("timestamp_ntz").alias("window_start"),
        w["end"].cast("timestamp_ntz").alias("window_end"),
        F.col("key.medicine_id").alias("medicine_id"),
        F.col("value.sum").cast("bigint").alias("units"),
        F.col("value.count").cast("bigint").alias("movements"),
    )


def write_alert_snapshot(stock: DataFrame, snapshot: KeyedSnapshot, checkpoint: str, transform,
                         available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """T2 in update mode: the changed items of a batch, labelled, go into the snapshot."""
    writer = stock.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: snapshot.apply(transform(batch), batch_id)
    ).option("checkpointLocation", checkpoint)
    return _trigger(writer, available_now, processing_time).start()


def utc_session(spark: SparkSession) -> SparkSession:
    """A child session (same SparkContext, own SQL conf) whose time zone is
    UTC, so event-time windows do not depend on the caller's session zone:
    the watermark needs a zoned TIMESTAMP, and the driver's wall-clock
    TIMESTAMP_NTZ values are read as UTC."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():  # inherit the caller's SQL settings
        if key.startswith("spark.sql.") and child.conf.isModifiable(key):
            child.conf.set(key, value)
    child.conf.set("spark.sql.session.timeZone", "UTC")
    return child


def _run_dir(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark, local_fallback=True)
    return subdir(base, f"{name}-{uuid.uuid4().hex}")


def event_glob(sf_dir: str) -> str:
    """A glob naming exactly the events file (a file stream source needs a
    folder or a glob, not a single file path)."""
    return f"{sf_dir.rstrip('/')}/events[.]parquet"


def _run_windows(spark: SparkSession, events_path: str) -> tuple[BatchFolders, str]:
    run = _run_dir(spark, "stock_movement_windows")
    windows = stock_movement_windows(movements(read_event_stream(utc_session(spark), events_path)))
    out = BatchFolders(spark, subdir(run, "closed"), windows.schema)
    write_closed_windows(windows, out, subdir(run, "checkpoint")).awaitTermination()
    return out, subdir(run, "checkpoint")


def run_closed_windows(spark: SparkSession, events_path: str) -> DataFrame:
    """T1 over the files available now: the windows that have closed."""
    return _run_windows(spark, events_path)[0].read()


def run_movement_windows(spark: SparkSession, events_path: str) -> DataFrame:
    """T1 over the files available now: closed windows, and the open ones as they stand."""
    closed, checkpoint = _run_windows(spark, events_path)
    return closed.read().unionByName(open_windows(spark, checkpoint))


def run_low_stock_alert(spark: SparkSession, events_path: str, medicines: DataFrame,
                        reorder: DataFrame, merge_every: int = MERGE_EVERY) -> DataFrame:
    """T2 end to end over the files available now; returns the latest labels per item."""
    run = _run_dir(spark, "low_stock_stream_alert")
    stock = running_stock(movements(read_event_stream(utc_session(spark), events_path)))
    static = spark.createDataFrame([], stock.schema)
    snapshot = KeyedSnapshot(spark, subdir(run, "items"), label_stock(static, medicines, reorder).schema,
                             ["medicine_id"], merge_every)
    write_alert_snapshot(stock, snapshot, subdir(run, "checkpoint"),
                         lambda b: label_stock(b, medicines, reorder)).awaitTermination()
    return snapshot.read()
