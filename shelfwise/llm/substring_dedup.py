"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes that can't repeat are left out first: only windows with a shared
anchor (``anchors``) go on. A suffix is cut at the window length and written
as five symbols of four words (64 + 4 x 32 bits of hash). Suffixes with the
same prefix form a group; the prefix is one symbol and grows, group by group,
until at most ``GROUP_ROWS`` suffixes share it, so a group fits in memory.
A group that a full-length prefix cannot split (one window, many times) is
salted by document, and the salts are merged through their smallest id.

Groups are sorted; neighbours' common prefixes give the subtree. Its internal
nodes at full depth are the repeats: every suffix below one, but the first in
(id, start) order, removes its words. The groups are streamed in order, so a
task holds one Arrow batch and the open node.

Exact copies of a text with a smaller id repeat every window; they are told
by their text hash and don't enter the tree. Null and empty texts have no
words. Null ids come last and don't count as earlier than each other. Rows
equal in id and text have the same result. An empty table gives no rows. A very
long text is cut into words at once and must fit its task some times over.
``dedup`` and ``strip`` carry other columns along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import anchors, common

WINDOW = 20
GRAM = 5
STEP = 4  # words per symbol
GROUP_ROWS = 100_000
SALTS = 64


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            flat, ends = common.flat_words(part.column("text"))
            word = common.word_hashes(flat)
            units = lambda _, k: (common.gram_hashes(word, k), ends)  # noqa: B023, E731  used at once
            starts, _, offsets = anchors.shared_windows(part, units, GRAM, WINDOW)
            if not len(starts):
                continue
            four = common.gram_hashes(word, STEP)
            row = np.searchsorted(offsets, starts, "right") - 1
            low = [four[starts + STEP * i] >> np.uint64(32) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(four[starts].view(np.int64)), pa.array(((low[0] << np.uint64(32)) | low[1]).view(np.int64)),
                 pa.array(((low[2] << np.uint64(32)) | low[3]).view(np.int64)),
                 part.column("ord").take(pa.array(row)), part.column("key").take(pa.array(row)), pa.array((starts - offsets[row]).astype(np.int64))],
                ["p1", "p2", "p3", "ord", "key", "start"])


_SUFFIX = "p1 bigint, p2 bigint, p3 bigint, ord bigint, key bigint, start bigint"
_PREFIX = ["p1", "xxhash64(p1, shiftright(p2, 32))", "xxhash64(p1, p2)", "xxhash64(p1, p2, shiftright(p3, 32))", "xxhash64(p1, p2, p3)"]


def grouped(suffixes: DataFrame, most: int = GROUP_ROWS) -> tuple[DataFrame, bool]:
    """Adds ``grp`` (prefix of variable length) and ``salt``; whether any group is salted.

    Suffixes whose first symbol is in a large group are stored, and only they
    are counted again for longer prefixes; the others keep the first symbol."""
    first = F.expr(_PREFIX[0])
    large = common.cut(suffixes.groupBy(first.alias("c")).count().where(F.col("count") > most).select("c"), "large-prefixes")
    plain = [F.lit(False).alias("salted"), F.lit(0).alias("salt")]
    if large.isEmpty():
        return suffixes.select("*", first.alias("grp"), *plain), False
    marks = common.broadcast_if_small(large, 16)
    some = common.cut(suffixes.join(marks, first == F.col("c"), "left_semi"), "large-suffixes")
    rest = suffixes.join(marks, first == F.col("c"), "left_anti").select("*", first.alias("grp"), *plain)
    some = some.withColumn("grp", first).withColumn("salted", F.lit(False))
    for depth in range(5):
        if depth:
            large = common.cut(some.groupBy("grp").count().where(F.col("count") > most).select(F.col("grp").alias("c")), "large-prefixes")
            if large.isEmpty():
                break
        mark = common.broadcast_if_small(large.select(F.col("c").alias("mark")), 16)
        some = some.join(mark, F.col("grp") == F.col("mark"), "left")
        held = F.col("mark").isNotNull()
        if depth < 4:
            some = some.withColumn("grp", F.when(held, F.expr(_PREFIX[depth + 1])).otherwise(F.col("grp"))).drop("mark")
        else:
            some = some.withColumn("salted", held).drop("mark")
    salt = F.when(F.col("salted"), F.pmod(F.xxhash64("ord", "key"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return rest.unionByName(some.withColumn("salt", salt)), depth == 4 and not large.isEmpty()


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in order; the open node (its symbols, salt, first id, last
    document and that one's first start) is carried over batches."""
    node = None
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("p1", "p2", "p3", "salt", "ord", "key", "start", "salted")}
        label = np.stack([c["p1"], c["p2"], c["p3"], c["salt"].astype(np.int64)])
        doc = np.stack([c["ord"], c["key"]])
        # Common prefix with the neighbour is the whole window: same deep node.
        new = np.concatenate([[node is None or not (label[:, 0] == node[0]).all()], (label[:, 1:] != label[:, :-1]).any(0)])
        other = new | np.concatenate([[node is None or not (doc[:, 0] == node[2]).all()], (doc[:, 1:] != doc[:, :-1]).any(0)])
        at = np.arange(len(new))
        open_node, open_doc = np.maximum.accumulate(np.where(new, at, -1)), np.maximum.accumulate(np.where(other, at, -1))
        first = np.where(open_node >= 0, c["ord"][np.maximum(open_node, 0)], node[1] if node else 0)
        begin = np.where(open_doc >= 0, c["start"][np.maximum(open_doc, 0)], node[3] if node else 0)
        gone = (c["ord"] > first) | (c["start"] > begin)
        node = (label[:, -1].copy(), int(first[-1]), doc[:, -1].copy(), int(begin[-1]))
        keep = gone | c["salted"]
        yield batch.select(["ord", "key", "start", "p1", "p2", "p3"]).append_column("gone", pa.array(gone)).filter(pa.array(keep))


def repeated(suffixes: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """(ord, key, start) of every window that an earlier suffix has."""
    rows, salted = grouped(suffixes, most)
    parts = rows.repartition("grp", "salt").sortWithinPartitions("p1", "p2", "p3", "salt", "ord", "key", "start")
    found = parts.mapInArrow(_tree, "ord bigint, key bigint, start bigint, p1 bigint, p2 bigint, p3 bigint, gone boolean")
    if not salted:
        return found.select("ord", "key", "start")
    found = common.cut(found, "salted-nodes")
    rest = found.where(~F.col("gone"))
    first = rest.groupBy("p1", "p2", "p3").agg(F.min("ord").alias("first"))
    late = rest.join(first, ["p1", "p2", "p3"]).where("ord > first")
    return found.where("gone").select("ord", "key", "start").unionByName(late.select("ord", "key", "start"))


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole copies as ord, key; window starts to remove as ord, key, starts)."""
    spark = docs.sparkSession
    with common.scratch(spark):
        same = copies(docs)
        texts = anchors.keyed(docs)
        texts = texts.join(common.broadcast_if_small(same, 32), ["ord", "key"], "left_anti")
        with common.scratch(spark):
            info = anchors.affected(texts, anchors.anchor_marks(anchors.word_units, GRAM, WINDOW), within=True)
            info = common.cut(info, "affected", keep=True)
        suffixes = anchors.with_info(texts, info, anchors.bytes_per_row(info, "places")[0]).mapInArrow(_suffixes, _SUFFIX)
        starts = repeated(suffixes).groupBy("ord", "key").agg(F.collect_set(F.col("start").cast("int")).alias("starts"))
        return common.cut(same, "text-copies", keep=True), common.cut(starts, "removed-windows", keep=True)


copies = anchors.copies


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            flat, offsets = common.flat_words(part.column("text"))
            kept, gone = [], []
            for i, starts in enumerate(part.column("__starts").to_pylist()):
                n = int(offsets[i + 1] - offsets[i])
                out = anchors.covered(np.asarray(starts, np.int64), WINDOW, n)
                gone.append(int(out.sum()))
                kept.append(" ".join(flat.slice(offsets[i], n).filter(pa.array(~out)).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c not in ("text", "__starts")), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                [*(c for c in part.schema.names if c not in ("text", "__starts")), "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, untouched: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text (and those with names given here), and n_words, n_removed, kept (the
    words that stay, joined by one blank). ``untouched``: the kept text of
    documents without removal is their own text with its white space."""
    same, windows = removals(docs)
    size = windows.agg(F.sum(F.size("starts") * 4 + 32).alias("b"), F.count("*").alias("n")).first()
    windows = common.broadcast_if_small(windows.toDF("__ord", "__key", "__starts"), -(-(size["b"] or 0) // max(1, size["n"])))
    same = common.broadcast_if_small(same.toDF("__ord", "__key"), 32)
    text = F.coalesce(F.col("text"), F.lit(""))
    results = ["n_words", "n_removed", "kept"]
    docs, names, known = *common.aside(docs, "doc_id", "text"), docs.columns
    rest = [n for n, c in zip(names, known) if c not in ("text", *results)]
    d = docs.select(*rest, text.alias("text"), F.coalesce("doc_id", F.lit(anchors.LAST_ID)).alias("__ord"), F.xxhash64(text).alias("__key"))
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c in rest)
    cut = d.join(windows, ["__ord", "__key"]).select(*rest, "text", "__starts").mapInArrow(
        _cut_words, f"{fields}, n_words bigint, n_removed bigint, kept string")
    words = common.words_of(F.col("text"))
    whole = d.join(windows, ["__ord", "__key"], "left_anti").join(same.withColumn("__copy", F.lit(True)), ["__ord", "__key"], "left")
    whole = whole.withColumn("__w", words).withColumn("__n", F.size("__w").cast("long"))
    lost = F.col("__copy").isNotNull() & (F.col("__n") >= WINDOW)
    whole = whole.select(*rest, F.col("__n").alias("n_words"), F.when(lost, F.col("__n")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
                         F.when(lost, F.lit("")).otherwise(F.col("text") if untouched else F.array_join("__w", " ")).alias("kept"))
    out = cut.unionByName(whole).select(*rest, *results)
    return out.toDF(*[known[names.index(n)] for n in rest], *results)


def strip(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated words; documents of which nothing stays go."""
    inner = [c if c in ("doc_id", "text", "n_chars") else f"__c{i}" for i, c in enumerate(docs.columns)]
    d = docs.toDF(*inner).withColumn("__none", F.col("text").isNull())
    d = dedup(d, untouched=True).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return d.withColumn("text", F.when(~F.col("__none"), F.col("kept"))).withColumn("n_chars", n_chars).select(*inner).toDF(*docs.columns)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
