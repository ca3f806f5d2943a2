"""Suffix-array dedup: bytes of 50-byte strings that an earlier document has.

Only windows with a shared anchor (``anchors``) can repeat, and of those only
windows whose anchor is shared together with 16 bytes beside it. The windows
of one anchor in one document are cut out as a segment; equal segments of different
documents are one, with the smallest id (combined before the shuffle). All
segments of an anchor fall into one shard of about ``SHARD_BYTES``; matches
between segments of different shards do not exist. Each shard builds the
suffix array of its segments by induced sorting (``induced``), computes the
permuted common prefixes, and every class of suffixes with a common prefix of
the window gets its smallest id. A window goes if that id is under its own.

Exact copies of a text with a smaller id are told by their text hash and don't
enter the arrays. Null and empty texts have no bytes. Null ids come last and
are not smaller than each other; the same holds for different texts with one
id. Rows equal in id and text have the same result. An empty table gives no
rows. A very long text is cut into windows at once and must fit its task some
times over. ``dedup`` carries other columns along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import anchors, common, induced

WINDOW = 50
GRAM = 16
SHARD_BYTES = 2 << 20
SEGMENT_BYTES = 40  # mean length, to choose the number of shards


def _segments(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=anchors.BLOCK_BYTES):
                starts, at, offsets = anchors.shared_windows(part, anchors.byte_units, GRAM, WINDOW, sides=2)
                if not len(starts):
                    continue
                data, _ = anchors.text_bytes(part.column("text"))
                new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
                begin, end = starts[new], starts[np.append(new[1:], len(starts)) - 1] + WINDOW
                size = end - begin
                flat = data[common.ranges(begin, size)]
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                grams = anchors.byte_grams(data, GRAM)
                shard = (common.mix(grams[at[new]]) % np.uint64(shards)).astype(np.int32)
                row = np.searchsorted(offsets, begin, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard), pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(flat)]),
                     part.column("ord").take(pa.array(row)), part.column("key").take(pa.array(row)), pa.array((begin - offsets[row]).astype(np.int64))],
                    ["shard", "segment", "ord", "key", "start"])

    return run


_SEGMENT = "shard int, segment binary, ord bigint, key bigint, start bigint"


def first_ids(segments: list[bytes], ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each window of each segment the smallest id that has it; offsets)."""
    size = np.asarray([len(x) for x in segments], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    t = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    # Characters from 2 by byte value, those that occur only; 1 stands between segments.
    used = np.bincount(t, minlength=256) > 0
    number = (np.cumsum(used) + 1).astype(np.uint8 if used.sum() < 254 else np.uint16)
    text = number[t]
    text[begin + size] = 1
    sa = induced.suffix_array(text, int(used.sum()) + 2)
    prefix = induced.permuted_prefixes(t, sa, window)[sa]
    n = size - window + 1
    starts = common.ranges(begin, n)
    owner = np.full(len(t), np.iinfo(np.int64).max, np.int64)
    owner[starts] = np.repeat(ids, n)
    # Neighbours with a common window form a class; zero bytes inside a text are told from ends by their place.
    cls = np.cumsum(prefix < window) - 1
    edges = np.flatnonzero(prefix < window)
    least = np.minimum.reduceat(owner[sa], edges)
    of = np.empty(len(t), np.int64)
    of[sa] = least[cls]
    return of[starts], np.concatenate([[0], np.cumsum(n)])


def _shard(group: pa.Table) -> pa.Table:
    segments = group.column("segment").to_pylist()
    first, ends = first_ids(segments, group.column("first").to_numpy(), WINDOW)
    # Segments of which no member loses a window need not go back.
    last = np.repeat(group.column("last").to_numpy(), np.diff(ends))
    some = np.logical_or.reduceat(first < last, ends[:-1]) if len(segments) else np.empty(0, bool)
    names = [hashlib.blake2b(x, digest_size=16).digest() for x in segments]
    return pa.table({"name": pa.array(names, pa.binary()),
                     "firsts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(first, pa.int64()))}).filter(pa.array(some))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [hashlib.blake2b(x, digest_size=16).digest() for x in batch.column("segment").to_pylist()]
        yield batch.select(["ord", "key", "start"]).append_column("name", pa.array(names, pa.binary()))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed byte runs [start, stop) of each member of a segment."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("firsts")
        ends = lists.offsets.to_numpy().astype(np.int64)
        n = np.diff(ends)
        first = lists.values.to_numpy()[ends[0]:ends[-1]]
        member = np.repeat(np.arange(len(n)), n)
        gone = first < batch.column("ord").to_numpy()[member]
        at = (batch.column("start").to_numpy()[member] + np.arange(len(first)) - np.repeat(ends[:-1] - ends[0], n))[gone]
        member = member[gone]
        new = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (at[1:] > at[:-1] + WINDOW)])) if len(at) else np.empty(0, np.int64)
        last = np.append(new[1:], len(at)) - 1 if len(at) else new
        yield pa.RecordBatch.from_arrays(
            [batch.column("ord").take(pa.array(member[new])), batch.column("key").take(pa.array(member[new])),
             pa.array(at[new]), pa.array(at[last] + WINDOW)], ["ord", "key", "start", "stop"])


def _placed(texts: DataFrame, info: DataFrame) -> DataFrame:
    """Texts with their places. Places grow with the texts, nearly all of which have some: they meet
    by a shuffle at any size, so that disk and the driver's memory grow no faster than the input."""
    return texts.join(info.hint("merge"), ["ord", "key"])


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole copies as ord, key; removed runs as ord, key, runs)."""
    spark = docs.sparkSession
    with common.scratch(spark):
        same = anchors.copies(docs)
        texts = anchors.keyed(docs)
        texts = texts.join(common.broadcast_if_small(same, 32), ["ord", "key"], "left_anti")
        with common.scratch(spark):
            info = anchors.affected(texts, anchors.anchor_marks(anchors.byte_units, GRAM, WINDOW), within=False)
            _, size = anchors.bytes_per_row(info, "places")
            # Second round: anchors with 16 bytes of context on the side where a window has them.
            info = anchors.affected(_placed(texts, info), anchors.context_marks(GRAM), within=False, size=size * 16)
            _, size = anchors.bytes_per_row(info, "places")
            shards = max(8, size // 8 * SEGMENT_BYTES // SHARD_BYTES)
            members = common.cut(_placed(texts, info).mapInArrow(_segments(int(shards)), _SEGMENT), "segments", keep=True)
        distinct = members.groupBy("shard", "segment").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
        firsts = common.cut(distinct.groupBy("shard").applyInArrow(_shard, "name binary, firsts array<bigint>"), "segment-firsts")
        named = members.mapInArrow(_named, "ord bigint, key bigint, start bigint, name binary")
        runs = named.join(firsts, "name").select("ord", "key", "start", "firsts").mapInArrow(
            _judge, "ord bigint, key bigint, start bigint, stop bigint")
        runs = runs.groupBy("ord", "key").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("a"), F.col("stop").cast("int").alias("b"))).alias("runs"))
        return common.cut(same, "text-copies", keep=True), common.cut(runs, "removed-runs", keep=True)


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            data, offsets = anchors.text_bytes(part.column("text"))
            kept, gone, spans = [], [], []
            runs = part.column("__runs")
            ends = runs.offsets.to_numpy()
            a, b = (runs.values.field(i).to_numpy() for i in (0, 1))
            for i in range(part.num_rows):
                delta = np.zeros(offsets[i + 1] - offsets[i] + 1, np.int64)
                np.add.at(delta, a[ends[i]:ends[i + 1]], 1)
                np.add.at(delta, b[ends[i]:ends[i + 1]], -1)
                out = np.cumsum(delta[:-1]) > 0
                gone.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum() + out[0]))
                kept.append(data[offsets[i]:offsets[i + 1]][~out].tobytes())
            names = [c for c in part.schema.names if c not in ("text", "__runs")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in names), pa.array(np.diff(offsets), pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text (and those with names given here), and n_bytes, n_removed, n_spans, kept (bytes that stay)."""
    same, runs = removals(docs)
    size = runs.agg(F.sum(F.size("runs") * 8 + 32).alias("b"), F.count("*").alias("n")).first()
    runs = common.broadcast_if_small(runs.toDF("__ord", "__key", "__runs"), -(-(size["b"] or 0) // max(1, size["n"])))
    same = common.broadcast_if_small(same.toDF("__ord", "__key"), 32)
    text = F.coalesce(F.col("text"), F.lit(""))
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    docs, names, known = *common.aside(docs, "doc_id", "text"), docs.columns
    rest = [n for n, c in zip(names, known) if c not in ("text", *results)]
    d = docs.select(*rest, text.alias("text"), F.coalesce("doc_id", F.lit(anchors.LAST_ID)).alias("__ord"), F.xxhash64(text).alias("__key"))
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in rest)
    cut = d.join(runs, ["__ord", "__key"]).select(*rest, "text", "__runs").mapInArrow(
        _cut_bytes, f"{fields}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    whole = d.join(runs, ["__ord", "__key"], "left_anti").join(same.withColumn("__copy", F.lit(True)), ["__ord", "__key"], "left")
    n, none = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    lost = F.col("__copy").isNotNull() & (n >= WINDOW)
    whole = whole.select(*rest, n.alias("n_bytes"), F.when(lost, n).otherwise(none).alias("n_removed"),
                         F.when(lost, F.lit(1).cast("long")).otherwise(none).alias("n_spans"),
                         F.when(lost, F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"))
    out = cut.unionByName(whole).select(*rest, *results)
    return out.toDF(*[known[names.index(n)] for n in rest], *results)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
