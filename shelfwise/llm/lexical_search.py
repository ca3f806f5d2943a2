"""Ranked lexical search by a dual-tree walk over items and documents.

One pass over the texts keeps of every document its number of terms and the
terms that occur in some item, with their counts (``vectors``, written to the
shared folder). The corpus counts N, L and the document frequencies come from
that table by map-side combining aggregates; a driver holds one number per term
of the items.

A score is a sum over terms of an item's part (weight times occurrences in the
item) and a document's part (saturated frequency), both integers of at least 0.
So for a group of items and a group of documents, the product of the
coordinate-wise maxima of the two groups bounds every score between them. Items
form one tree per block: leaves of single items, nodes of neighbours in the
order of their heaviest term. The documents of a batch form another: leaves of
``LEAF`` documents, nodes of ``FAN`` leaves, in the order of their heaviest
term. A task walks both trees level by level and leaves out every node pair
whose bound is under the weakest k-th score of the items of the node; equal
scores are never left out. What is left is scored exactly, and a task gives at
most k rows per item. The k-th scores of a first, smaller run over some
documents are the starting thresholds of the run over all documents; they only
speed it up, as they are scores of documents of the table.

Sizes: the items are a stated query set. Their distinct terms are held in groups
of at most ``VOCABULARY_BYTES`` of item text (one pass over the texts per group),
and dense maxima in blocks of about ``CELLS`` numbers (one pass over the stored
vectors per block). Each block's result is written and its broadcast released
before the next block. A single item must fit a task.

Defined results: null texts, and texts without terms, have none, take no part
in N and L, and are never found. A null doc_id counts as the smallest id and
comes back as null. Repeated rows are documents of their own. Repeated items
are asked once; rows with the same item_id and other texts (or a null item_id)
are items of their own, each with ranks from 1. Empty tables give no rows. Other
columns, also ones named like a result, are ignored. Scores must fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import common

TOP = 20
# Fixed values of the score: weight scale, saturation and length parts.
WEIGHT, FULL, SATURATE, STEP, LENGTH = 1000, 1_000_000_000, 1000, 12, 25
VOCABULARY_BYTES = 16 << 20
CELLS = 4 << 20
# Documents of a leaf, leaves of a node, documents of a batch, items of a node.
LEAF, FAN, BATCH, ITEMS = 32, 8, 2048, 8
# Documents, at most, of the run that finds starting thresholds.
FIRST_DOCS = 20_000
LOWEST = np.iinfo(np.int64).min
VECTORS = "doc_id bigint, n bigint, codes array<int>, counts array<int>"
FOUND = "item bigint, doc_id bigint, score bigint"

# Terms are runs of digits, letters and all bytes over 0x7F; others become blanks.
_TERM_BYTES = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTES[_a:_b + 1] = np.arange(_a, _b + 1)
_TERM_BYTES[0x41:0x5B] += 0x20


def terms_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a text column in one array, and the row offsets into it."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[int(offsets[0]):int(offsets[-1])]
    clean = pa.LargeStringArray.from_buffers(
        len(text), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_TERM_BYTES[data]))
    return common.flat_words(clean)


# --- vectors over the terms of the items ------------------------------------

def _vectors(shared):
    def one(part: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
        flat, ends = terms_of(part.column("text"))
        code = pc.index_in(flat, value_set=vocabulary)
        row = np.repeat(np.arange(part.num_rows), np.diff(ends))
        known = pc.is_valid(code).to_numpy(zero_copy_only=False)
        width = max(1, len(vocabulary))
        key, count = np.unique(row[known] * width + code.drop_null().to_numpy().astype(np.int64), return_counts=True)
        offsets = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * width).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(np.diff(ends)),
             pa.ListArray.from_arrays(offsets, pa.array((key % width).astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32)))],
            ["doc_id", "n", "codes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value, pa.large_string())
        for batch in batches:
            for part in common.slices(batch):
                yield one(part, vocabulary)

    return run


class Counts:
    """What the score needs of the corpus: N, L and the weight of every term."""

    def __init__(self, vectors: DataFrame, n_terms: int):
        row = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        self.docs, self.terms = int(row.docs), int(row.terms or 0)
        df = np.zeros(n_terms, np.int64)
        held = vectors.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()
        df[held.column("code").to_numpy()] = held.column("count").to_numpy()
        self.weight = np.array([math.floor(WEIGHT * math.log((2 * self.docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)

    def parts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """A document's part of the score, for a term tf times in n terms."""
        wide = len(n) and LENGTH * int(n.max()) * self.docs >= 2 ** 63
        n = n.astype(object) if wide else n.astype(np.int64)
        m = 100 - LENGTH + (LENGTH * n * self.docs) // max(1, self.terms)
        return ((FULL * tf.astype(np.int64)) // (SATURATE * tf.astype(np.int64) + STEP * m)).astype(np.int64)


# --- trees ------------------------------------------------------------------

def _maxima(row: np.ndarray, code: np.ndarray, value: np.ndarray, n_rows: int, n_codes: int) -> np.ndarray:
    out = np.zeros((n_rows, n_codes))
    np.maximum.at(out, (row, code), value)
    return out


def _by_heaviest(row: np.ndarray, code: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Rows in the order of their heaviest coordinate."""
    order = np.lexsort((code, -value, row))
    first = order[np.searchsorted(row[order], np.arange(n)).clip(max=max(0, len(order) - 1))] if len(order) else np.zeros(n, np.int64)
    heaviest = np.full(n, -1, np.int64)
    has = np.bincount(row, minlength=n) > 0
    heaviest[has] = code[first[has]]
    return np.argsort(heaviest, kind="stable")


class ItemTree:
    """Items of one block as dense rows over the terms of the block; a node is
    ``ITEMS`` neighbours, and the root is all."""

    def __init__(self, item: np.ndarray, code: np.ndarray, value: np.ndarray):
        self.codes, local = np.unique(code, return_inverse=True)
        ids, row = np.unique(item, return_inverse=True)
        order = _by_heaviest(row, local, value, len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        self.rows = np.zeros((len(ids), len(self.codes)))
        np.add.at(self.rows, (place[row], local), value)
        self.node = np.arange(len(ids)) // ITEMS
        edges = np.arange(0, len(ids), ITEMS)
        self.nodes = np.maximum.reduceat(self.rows, edges, axis=0)
        self.root = self.nodes.max(0)
        self.most = float(self.rows.sum(1).max(initial=0))


class Walk:
    """Running best documents of the items of one block."""

    def __init__(self, tree: ItemTree, least: np.ndarray, top: int):
        self.tree, self.top = tree, top
        self.least = least.astype(np.int64).copy()  # a score under it can't be among the best
        n = len(tree.ids)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in range(n)]
        self.scored = 0

    def weakest(self) -> np.ndarray:
        return np.minimum.reduceat(self.least, np.arange(0, len(self.least), ITEMS))

    def add(self, ids: np.ndarray, null: np.ndarray, row: np.ndarray, code: np.ndarray, part: np.ndarray) -> None:
        """Documents of one batch; coordinates (row, code of the block, part)."""
        tree, n = self.tree, len(ids)
        if not len(row):
            return
        order = _by_heaviest(row, code, part * tree.root[code], n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ids, null, row = ids[order], null[order], place[row]
        by_row = np.argsort(row, kind="stable")
        row, code, part = row[by_row], code[by_row], part[by_row]
        used, local = np.unique(code, return_inverse=True)
        leaves = _maxima(row // LEAF, local, part, -(-n // LEAF), len(used))
        groups = np.maximum.reduceat(leaves, np.arange(0, len(leaves), FAN), axis=0)
        slack = 1 + 1e-9  # sums of doubles; a bound must not be rounded down
        # Root of the items against groups of leaves, then nodes of items, then leaves of documents.
        alive_groups = np.flatnonzero(slack * (groups @ tree.root[used]) >= max(1, self.least.min()))
        if not len(alive_groups):
            return
        nodes = tree.nodes[:, used]
        reach = slack * (groups[alive_groups] @ nodes.T)
        open_leaf = np.zeros((len(leaves), len(nodes)), bool)
        for g, near in zip(alive_groups, reach >= np.maximum(1, self.weakest())):
            open_leaf[g * FAN:(g + 1) * FAN] = near
        rows = np.flatnonzero(open_leaf.any(1))
        bound = np.zeros(open_leaf.shape)
        bound[rows] = slack * (leaves[rows] @ nodes.T) * open_leaf[rows]
        edges = np.searchsorted(row, np.arange(0, n + LEAF, LEAF).clip(max=n))
        for leaf in rows[np.argsort(-bound[rows].max(1), kind="stable")]:
            near = np.flatnonzero(bound[leaf] >= np.maximum(1, self.weakest()))
            if not len(near):
                continue
            items = np.flatnonzero(np.isin(tree.node, near))
            # Leaves of the items against the leaf of documents.
            have = np.flatnonzero(leaves[leaf])
            reach = slack * (tree.rows[np.ix_(items, used[have])] @ leaves[leaf, have])
            items = items[reach >= np.maximum(1, self.least[items])]
            if not len(items):
                continue
            s = slice(edges[leaf], edges[leaf + 1])
            self.score(items, leaf * LEAF, ids, null, row[s], code[s], part[s])

    def score(self, items: np.ndarray, first: int, ids, null, row, code, part) -> None:
        here, local = np.unique(code, return_inverse=True)
        n = min(LEAF, len(ids) - first)
        # Doubles are exact up to 2 ** 53, longs beyond.
        kind = np.float64 if self.tree.most * float(part.max()) < 2 ** 53 else np.int64
        docs = np.zeros((n, len(here)), kind)
        docs[row - first, local] = part
        score = (self.tree.rows[np.ix_(items, here)].astype(kind) @ docs.T).astype(np.int64)
        self.scored += score.size
        hits = (score > 0) & (score >= self.least[items, None])
        for i in np.flatnonzero(hits.any(1)):
            at = np.flatnonzero(hits[i])
            self.keep(items[i], score[i, at], ids[first + at], null[first + at])

    def keep(self, item: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, d, z = (np.concatenate(x) for x in zip(self.best[item], (score, ids, null)))
        order = np.lexsort((d, ~z, -s))[:self.top]
        self.best[item] = s[order], d[order], z[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], s[order[-1]])

    def result(self) -> pa.RecordBatch:
        s, d, z = (np.concatenate([b[i] for b in self.best]) for i in range(3))
        item = np.repeat(self.tree.ids, [len(b[0]) for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(d, mask=z), pa.array(s)], ["item", "doc_id", "score"])


def _walk(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tree, least = shared.value
        walk = Walk(tree, least, top)
        to_block = np.full(len(counts.weight), -1, np.int64)
        to_block[tree.codes] = np.arange(len(tree.codes))
        step = min(BATCH, max(LEAF, CELLS // max(1, len(tree.codes)) * LEAF))  # bounds the dense maxima of leaves
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, lists = part.column("doc_id"), part.column("codes")
                ends = lists.offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                code = to_block[lists.flatten().to_numpy()]
                tf, n = part.column("counts").flatten().to_numpy(), part.column("n").to_numpy()
                known = code >= 0
                row, code, tf = row[known], code[known], tf[known]
                walk.add(pc.fill_null(ids, int(LOWEST)).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False),
                         row, code, counts.parts(n[row], tf))
        yield walk.result()

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _block(vectors: DataFrame, counts: Counts, tree: ItemTree, top: int) -> DataFrame:
    """Best documents of the items of one block, written to the shared folder."""
    sc = vectors.sparkSession.sparkContext
    least = np.zeros(len(tree.ids), np.int64)
    if counts.docs > 4 * FIRST_DOCS:
        shared = sc.broadcast((counts, tree, least))
        some = vectors.sample(FIRST_DOCS / counts.docs, seed=1).mapInArrow(_walk(shared, top), FOUND)
        held = _best(some, top).where(F.col("rank") == top).select("item", "score").toArrow()
        at = {int(i): k for k, i in enumerate(tree.ids)}
        for item, score in zip(held.column("item").to_pylist(), held.column("score").to_pylist()):
            least[at[item]] = score
        shared.unpersist()
    shared = sc.broadcast((counts, tree, least))
    found = common.cut(_best(vectors.mapInArrow(_walk(shared, top), FOUND), top), "search-found")
    shared.unpersist()
    return found


# --- items ------------------------------------------------------------------

def _item_blocks(item: np.ndarray, n_terms: int) -> list[np.ndarray]:
    """Row ranges (as index arrays) whose dense maxima stay near ``CELLS``."""
    ids = np.unique(item)
    blocks = max(1, math.ceil(math.sqrt(len(ids) * n_terms / CELLS)))
    return [np.flatnonzero(np.isin(item, b)) for b in np.array_split(ids, blocks) if len(b)]


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item by score."""
    spark = docs.sparkSession
    asked = common.cut(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct(), "search-items")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // VOCABULARY_BYTES))
    documents = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = []
    for g in range(groups):  # one, unless the items alone are larger than a broadcast may be
        held = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        flat, ends = terms_of(held.column("text").combine_chunks())
        coded = flat.dictionary_encode()
        item = np.repeat(np.arange(held.num_rows), np.diff(ends))
        code = coded.indices.to_numpy().astype(np.int64)
        words = spark.sparkContext.broadcast(coded.dictionary.to_pylist())
        vectors = common.cut(documents.mapInArrow(_vectors(words), VECTORS), "search-vectors")
        words.unpersist()
        counts = Counts(vectors, len(coded.dictionary))
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(held.num_rows)), "item_id": held.column("item_id")}))
        for rows in _item_blocks(item, len(coded.dictionary)):
            tree = ItemTree(item[rows], code[rows], counts.weight[code[rows]])
            out.append(_block(vectors, counts, tree, top).join(names, "item"))
    result = "item_id bigint, rank int, doc_id bigint, score bigint"
    if not out:
        return spark.createDataFrame([], result)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
