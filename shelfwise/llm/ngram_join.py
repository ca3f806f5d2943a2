"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Equal
sets form one class; classes are joined, documents only carry their class.

If two sets of sizes n and m reach the similarity, they share at least
need = ceil(similarity * max(n, m)) shingles, and in any order common to all
sets the first n - need + l of one and m - need + l of the other share at
least l. The order is: shingles that are not hot by hash, then hot ones by
frequency. Hot are those that more than ``HOT`` classes hold among their
smallest hashes, counted over all documents, or in the whole sets of those
that are read once more for it. Every class picks the l from 1 to ``LEVELS`` with the least
estimated cost, prefix entries read plus sets compared; the expected
candidates of a hot shingle are its count, those of the others one each. A
pair is compared only if it shares min(l, l') prefix shingles, counted no
further than the sizes of both allow.

The scan keeps the smallest hashes of a set, some more than the first prefix.
Classes whose prefix reaches into hot shingles (near copies in large groups,
boilerplate) read their text once more for the whole set; so do the classes
of the pairs that are compared.

Large groups of near copies: each prefix shingle of over ``LARGE`` classes names
the most central class of its bucket (fewest rarer shingles), every class is compared with those,
and the links found form components. The join proper then leaves out pairs
that are in one component already: they can't change the classes. No other
pair is left out, so the components are those of all links, while a group of
m near copies costs about m comparisons in place of m squared. The links that
``join`` returns are therefore spanning links, enough for the components.

All links are inside components, so ``link_counts`` compares every two classes
of a component for the number of links: components are dealt in blocks of at
most about ``BLOCK`` classes and ``BLOCK_SHINGLES`` shingles, every two blocks
meet in a task, and only a count per class and block pair leaves it.

Null and empty texts have no shingle, class or link: their component is their
own id. Rows with equal text are linked, also if ids repeat; null ids don't
count for the smallest id. An empty table gives no rows. Other columns don't
matter; ``keep_one`` carries them along whatever their names. A very long text
is one row of its shingles, which must fit its task some times over. Two different
shingles of a pair share a 64-bit hash with a chance of about n * m / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import common
from shelfwise.llm.components import components

WORDS = 3
PERCENT = 90
HOT = 3
# Buckets above this size are joined with whole prefixes and get a hub first.
LARGE = 32
LEVELS = 16
SPARE = 16
SLICE_BYTES = 1 << 20
# Cost of comparing two sets, in prefix entries, per shingle of the set.
COMPARE = 0.05
BLOCK = 256
BLOCK_SHINGLES = 1 << 19
# Small components that are counted together in one task hold about this many shingles.
BUNDLE_SHINGLES = 1 << 20
# Shingles of two blocks that are multiplied at once.
COLUMNS = 4096


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each row."""
    flat, offsets = common.flat_words(pc.ascii_lower(batch.column("text")))
    word = common.word_hashes(flat)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    grams = common.gram_hashes(word, k)
    inside = np.arange(len(grams)) + k <= offsets[row[:len(grams)] + 1]
    hashes, rows = [grams[inside]], [row[:len(grams)][inside]]
    for short in range(1, k):  # the whole text is the one shingle
        at = np.flatnonzero(n == short)
        acc = np.full(len(at), short, np.uint64)
        for i in range(short):
            acc = common.mix(acc * np.uint64(0x9E3779B97F4A7C15) + word[offsets[at] + i])
        hashes.append(acc)
        rows.append(at)
    h, r = np.concatenate(hashes).view(np.int64), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.searchsorted(r, np.arange(len(n) + 1))


def _sets(k: int, percent: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=SLICE_BYTES):
                h, ends = shingle_sets(part, k)
                size = np.diff(ends)
                names = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() if b > a else None
                         for a, b in zip(ends, ends[1:])]
                # The first prefix is all but the needed shingles, and one; some more are kept to stand in for hot ones.
                first = size - -(-size * percent // 100) + 1
                width = size if whole else np.minimum(size, first + first // 4 + SPARE)
                kept = pa.array(h[common.ranges(ends[:-1], width)])
                at = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(size, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(at, kept)],
                    ["doc_id", "key", "n", "cls", "tokens"])

    return run


_SCHEMA = "doc_id bigint, key bigint, n bigint, cls binary, tokens array<bigint>"


def close(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose whole sets reach the similarity."""
    a = sets.select(F.col("cls").alias("u"), F.col("tokens").alias("a"))
    b = sets.select(F.col("cls").alias("v"), F.col("tokens").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(
        both * 100 >= (F.size("a") + F.size("b") - both) * percent).select("u", "v")


def _width(n: Column, percent: int) -> Column:
    """Shingles that a partner may miss: the prefix for l matches is this wide, and l."""
    return (F.col("n") - F.ceil(F.col("n") * percent / 100)).cast("int")


def ordered(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds hot (df, token; by df) and cold (the others, by hash) to sets or to their smallest hashes."""
    held = sets.select("cls", F.explode("tokens").alias("token")).join(common.broadcast_if_small(hot, 24), "token")
    held = held.groupBy("cls").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("hot"))
    d = sets.join(held, "cls", "left").withColumn("hot", F.coalesce("hot", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    return d.withColumn("cold", F.array_except("tokens", "hot.token"))


def choose(n: np.ndarray, own: np.ndarray, hot: np.ndarray, ends: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, prefix length) of the least cost for sets of n shingles, of which
    ``own`` are not hot, then the hot ones (their counts are hot[ends[i]:ends[i + 1]])."""
    start, known = ends[:-1], own + np.diff(ends)
    width = n - np.ceil(n * percent / 100).astype(np.int64)
    # Most candidates are of about the same size, and meet within this much narrower part of the prefix.
    alike = n - np.ceil(n * (2 * percent) / (100 + percent)).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(hot, dtype=np.int64)])
    level = np.arange(1, LEVELS + 1)
    reach = np.minimum(known[:, None], alike[:, None] + level)
    deep = np.maximum(reach - own[:, None], 0)
    entries = np.minimum(reach, own[:, None]) + upto[start[:, None] + deep] - upto[start][:, None]
    cost = entries * (1 + n[:, None] * COMPARE / level)
    most = np.maximum(1, np.minimum(LEVELS, known - width))
    best = np.where(level <= most[:, None], cost, np.inf).argmin(1) + 1 if len(n) else np.empty(0, np.int64)
    return best, np.minimum(known, width + best)


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cold, hot = batch.column("cold"), batch.column("hot")
            n, own = batch.column("n").to_numpy(), pc.list_value_length(cold).to_numpy().astype(np.int64)
            pairs, count = hot.flatten(), pc.list_value_length(hot).to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(count)])
            level, size = choose(n, own, pairs.field("df").to_numpy(), ends, percent)
            # The order of a set: its cold shingles, then its hot ones.
            order = np.concatenate([cold.flatten().to_numpy(), pairs.field("token").to_numpy()])
            from_cold = np.minimum(size, own)
            first = np.stack([np.cumsum(own) - own, own.sum() + ends[:-1]], 1).reshape(-1)
            taken = np.stack([from_cold, size - from_cold], 1).reshape(-1)
            prefix = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(order[common.ranges(first, taken)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("doc_id"), batch.column("n"), pa.array(level, pa.int32()), pa.array(own, pa.int32()), prefix],
                ["cls", "doc_id", "n", "l", "own", "prefix"])

    return run


def prefixes(d: DataFrame, percent: int) -> DataFrame:
    """cls, doc_id, n, l, own (shingles that are not hot), prefix: the adaptive
    prefix of every class. The order is known to its end, or as far as cold goes."""
    return d.select("cls", "doc_id", "n", "hot", "cold").mapInArrow(
        _prefixes(percent), "cls binary, doc_id bigint, n bigint, l int, own int, prefix array<bigint>")


def shared_entries(prefix: DataFrame) -> DataFrame:
    """cls, n, l, at, token, large: the prefix shingles that more than one class has.
    All entries meet once by shingle, as a number and a place; neither the shingles
    nor the classes pass through the driver, as both grow with the documents."""
    met = prefix.select("number", F.posexplode("prefix").alias("at", "token"))
    met = met.withColumn("k", F.count("*").over(W.partitionBy("token"))).where("k > 1")
    met = met.select("number", "at", "token", (F.col("k") > LARGE).alias("large"))
    return met.join(prefix.select("number", "cls", "n", "l").hint("merge"), "number").drop("number")


def star_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Every class of a large bucket with the most central one of the bucket."""
    large = entries.where("large")
    hub = large.groupBy("token").agg(F.min(F.struct("at", "cls", "n")).alias("hub"))
    met = large.join(hub, "token").where((F.col("cls") != F.col("hub.cls")) & close(F.col("n"), F.col("hub.n"), percent))
    return met.select(F.greatest("cls", F.col("hub.cls")).alias("u"), F.least("cls", F.col("hub.cls")).alias("v")).distinct()


def cross_pairs(entries: DataFrame, prefix: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share enough prefix shingles.

    Two sets of n and m reach the similarity with need = ceil(percent * (n + m)
    / (100 + percent)) common shingles, so a pair counts only matches among its
    first n - need + l and m - need + l. Pairs that meet there in a large
    bucket are made at the smallest such token; all others meet in small
    buckets only, and their meetings are their matches.
    """
    d = entries.join(common.broadcast_if_small(root, 48), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    mixed = d.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    d = common.cut(d.join(mixed, "token").select("token", "at", "cls", "n", "l", "root", "large"), "ngram-mixed")
    least = F.least("a.l", "b.l")
    # What this pair may miss on either side is known once both sizes are: never more than the width of its prefix.
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    reach_a, reach_b = ((F.col(f"{x}.n") - need + least).cast("int") for x in "ab")

    def meet(side: DataFrame, more=None) -> DataFrame:
        a, b = side.alias("a"), side.alias("b")
        on = ((F.col("a.token") == F.col("b.token")) & (F.col("a.cls") > F.col("b.cls")) & (F.col("a.root") != F.col("b.root"))
              & close(F.col("a.n"), F.col("b.n"), percent) & (F.col("a.at") < reach_a) & (F.col("b.at") < reach_b))
        return a.join(b, on if more is None else on & more).select(
            F.col("a.cls").alias("u"), F.col("b.cls").alias("v"), least.alias("l"))

    small = meet(d.where(~F.col("large"))).groupBy("u", "v").agg(F.count("*").alias("k"), F.first("l").alias("l")).where("k >= l")
    large = d.where("large")
    held = large.groupBy("cls").agg(F.collect_set("token").alias("tops")).join(prefix.select("cls", "prefix").dropDuplicates(["cls"]), "cls")
    both = F.array_intersect(F.slice("a.prefix", F.lit(1), reach_a), F.slice("b.prefix", F.lit(1), reach_b))
    enough = (F.size(both) >= least) & (F.array_min(F.array_intersect(both, "a.tops")) == F.col("a.token"))
    return small.select("u", "v").unionByName(meet(large.join(held, "cls"), enough).select("u", "v")).distinct()


def whole_sets(text: DataFrame, chosen: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """cls, doc_id, n and all shingles of the chosen (cls, doc_id)."""
    ids = chosen.select(F.col("doc_id").alias("id")).distinct()
    rows = text.join(common.broadcast_if_small(ids, 16), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = rows.mapInArrow(_sets(k, percent, True), _SCHEMA).join(common.broadcast_if_small(chosen.select("cls"), 32), "cls", "left_semi")
    sets = common.cut(sets, name)
    names = sets.agg(F.count("*"), F.countDistinct("cls")).first()
    return sets if names[0] == names[1] else sets.dropDuplicates(["cls"])  # repeated rows


def merged(root: DataFrame, cross: DataFrame) -> DataFrame:
    """(cls, root) after the links ``cross`` between components: only their roots meet again."""
    for end in "uv":
        to = root.select(F.col("cls").alias(end), F.col("root").alias("to"))
        cross = cross.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    top = components(cross).select(F.col("node").alias("root"), F.col("root").alias("top"))
    rest = top.where("root <> top").join(root.select("root").distinct(), "root", "left_anti")
    old = root.join(top, "root", "left").select("cls", F.coalesce("top", "root").alias("root"))
    return old.unionByName(rest.select(F.col("root").alias("cls"), F.col("top").alias("root")))


def grouped(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key, n, cls of every row, key being the hash of its text; cls and
    root of every linked class; spanning links between classes)."""
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    rows = common.cut(text.mapInArrow(_sets(k, percent, False), _SCHEMA), "ngram-rows")
    names = rows.where("cls is not null")
    copied = common.cut(names.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").select("cls", "least"), "ngram-copied")
    reps = names.join(common.broadcast_if_small(copied, 40), "cls", "left").where(F.col("least").isNull() | (F.col("doc_id") == F.col("least"))).drop("least")

    kept = reps.select(F.explode("tokens").alias("token"))
    hot = common.cut(kept.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > HOT), "ngram-hot")
    # Partial lists are enough where they hold a whole prefix of shingles that are not hot.
    width = _width(F.col("n"), percent)
    near = ordered(reps, hot).select("cls", "doc_id", "n", F.when(
        F.size("cold") > width, F.slice("cold", F.lit(1), width + LEVELS)).alias("cold"))
    near = common.cut(near, "ngram-near")
    deep = whole_sets(text, common.cut(near.where("cold is null").select("cls", "doc_id"), "ngram-deep-names"), k, percent, "ngram-deep")
    # Whole sets show frequent shingles that are not among the smallest hashes: those count as hot as well, for all classes.
    full = deep.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > HOT)
    more = common.cut(full.join(common.broadcast_if_small(hot.select("token"), 16), "token", "left_anti"), "ngram-more-hot")
    hot = common.cut(hot.unionByName(full).groupBy("token").agg(F.max("df").alias("df")), "ngram-all-hot")
    left = ordered(near.where("cold is not null").select("cls", "doc_id", "n", F.col("cold").alias("tokens")), more)
    near = common.cut(left.select("cls", "doc_id", "n", F.when(F.size("cold") > width, F.col("cold")).alias("cold")), "ngram-near")
    deep = deep.unionByName(whole_sets(text, common.cut(near.where("cold is null").select("cls", "doc_id"), "ngram-deep-names"), k, percent, "ngram-deep"))
    none = F.array().cast("array<struct<df:bigint,token:bigint>>").alias("hot")
    prefix = prefixes(near.where("cold is not null").select("cls", "doc_id", "n", none, "cold").unionByName(
        ordered(deep, hot).select("cls", "doc_id", "n", "hot", "cold")), percent)
    prefix = common.cut(prefix.withColumn("number", F.monotonically_increasing_id()), "ngram-prefixes")  # stored, so it lasts
    entries = common.cut(shared_entries(prefix), "ngram-entries")

    pairs = common.cut(star_pairs(entries, percent), "ngram-star-pairs")
    star = common.cut(compare(pairs, prefix, text, k, percent), "ngram-star")
    root = common.cut(components(star).select(F.col("node").alias("cls"), "root"), "ngram-root")
    pairs = common.cut(cross_pairs(entries, prefix, root, percent), "ngram-cross-pairs")
    cross = common.cut(compare(pairs, prefix, text, k, percent), "ngram-cross")
    return rows.select("doc_id", "key", "n", "cls"), merged(root, cross), star.unionByName(cross)


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, cls of every row; spanning links between classes)."""
    rows, root, links = grouped(docs, k, percent)
    names = rows.where("cls is not null")
    named = names.groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(root, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "root").select("cls", "component_id")
    out = rows.select("doc_id", "n", "cls").join(of, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "cls")
    return out, links


def compare(pairs: DataFrame, named: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that reach the similarity; whole sets are read for their classes only."""
    chosen = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    chosen = common.cut(named.select("cls", "doc_id").distinct().join(chosen, "cls"), "ngram-chosen")
    return verify(pairs, whole_sets(text, chosen, k, percent, "ngram-sets"), percent)


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    sides = []
    for sets, flat in ((a, flat_a), (b, flat_b)):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, flat)
        held = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((row[held][order], at[held][order]))
    for start in range(0, len(both), COLUMNS):
        m = []
        for sets, (row, at) in zip((a, b), sides):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            part = np.zeros((len(sets), min(COLUMNS, len(both) - start)), np.float32)
            part[row[lo:hi], at[lo:hi] - start] = 1
            m.append(part)
        out += m[0] @ m[1].T  # at most COLUMNS a cell, exact
    return out


def _count_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        copies = table.column("copies").to_numpy()
        roots = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        tokens = table.column("tokens").combine_chunks()
        flat, ends = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
        classes, rows = np.zeros(len(side), np.int64), np.zeros(len(side), np.int64)
        order = np.argsort(roots, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(roots[order])) + 1):
            # Side 0 meets side 1; side 2 is a block that meets itself.
            whole = bool(side[group[0]] == 2)
            a = group if whole else group[side[group] == 0]
            b = group if whole else group[side[group] == 1]
            if not len(a) or not len(b):
                continue
            set_a = [flat[ends[i]:ends[i + 1]] for i in a]
            set_b = set_a if whole else [flat[ends[i]:ends[i + 1]] for i in b]
            both = common_shingles(set_a, set_b)
            sizes = np.add.outer([len(x) for x in set_a], [len(x) for x in set_b])
            link = both * 100 >= (sizes - both) * percent
            if whole:
                np.fill_diagonal(link, False)
            classes[a] += link.sum(1)
            rows[a] += link @ copies[b]
            if not whole:
                classes[b] += link.sum(0)
                rows[b] += copies[a] @ link
        out = pa.table({"cls": table.column("cls"), "n_classes": classes, "n_rows": rows})
        return out.filter(pc.greater(out.column("n_classes"), 0))

    return run


def link_counts(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_links (other rows that reach the similarity, copies included)
    and n_classes (different sets among them) of every row."""
    rows, root, _ = grouped(docs, k, percent)
    named = rows.where("cls is not null")
    # Copies of a class count once; the smallest id stands for it (null ids if there is no other).
    classes = common.cut(named.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "ngram-classes")
    root = root.unionByName(root.select(F.col("root").alias("cls"), "root")).distinct()  # with the roots themselves
    linked = common.cut(classes.join(root, "cls"), "ngram-linked")
    text = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    sets = whole_sets(text, linked.select("cls", "doc_id"), k, percent, "ngram-linked-sets").select("cls", "tokens")
    group = linked.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    group = common.cut(group.withColumn("blocks", F.least(blocks, F.col("m").cast("int"))), "ngram-groups")
    total = group.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("root"), F.lit(max(1, total // BUNDLE_SHINGLES))).cast("int")
    d = linked.drop("doc_id", "n").join(group.select("root", "blocks"), "root")
    own = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    d = d.select(
        "cls", "copies", "root", F.when(~one, F.col("root")).alias("of"),
        F.when(one, bundle).otherwise(F.least("own", "other")).alias("lo"), F.when(one, 0).otherwise(F.greatest("own", "other")).alias("hi"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    met = d.join(sets, "cls").groupBy("of", "lo", "hi").applyInArrow(_count_links(percent), "cls binary, n_classes bigint, n_rows bigint")
    count = common.cut(met, "ngram-block-counts").groupBy("cls").agg(F.sum("n_classes").alias("n_classes"), F.sum("n_rows").alias("n_rows"))
    # Only classes with a link or a copy take part in the join back to the rows.
    count = classes.select("cls", "copies").join(count, "cls", "left").where("copies > 1 OR n_rows > 0")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "cls").join(count, "cls", "left").select(
        "doc_id", (F.coalesce("n_rows", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"),
        F.coalesce("n_classes", zero).alias("n_classes"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id (null last;
    ties by class and text hash). Groups are told apart by their root and rows by
    id and text hash, as ids may be null or name several texts. Rows without
    shingles are in no group and stay."""
    docs, inner, known = *common.aside(docs, "doc_id", "text"), docs.columns
    rows, root, _ = grouped(docs, k, percent)
    # Rows equal in id and text, then classes, then groups: each step has few rows left for the next.
    same = rows.where("cls is not null").groupBy("cls", "doc_id", "key").agg(F.count("*").alias("n"))
    least = same.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("m"))
    one = least.join(root, "cls", "left").groupBy(F.coalesce("root", "cls").alias("root")).agg(
        F.min(F.struct("m.none", "m.doc_id", "cls", "m.key", "m.n")).alias("m")).select("m.doc_id", "m.key", "m.n")
    bare = rows.where("cls is null").select("doc_id", "key", F.lit(1).cast("long").alias("n")).distinct()
    one = common.cut(one.unionByName(bare).select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), "n"), "ngram-keep")
    d = docs.withColumn("__key", F.xxhash64("text"))

    def named(which: str) -> DataFrame:
        names = one.where(which).select("__id", "__k")
        return d.join(common.broadcast_if_small(names, 24), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")

    left = named("n = 1")
    if not one.where("n > 1").isEmpty():  # repeated rows: one of them stays
        left = left.unionByName(named("n > 1").dropDuplicates(["doc_id", "__key"]))
    return left.select(*inner).toDF(*known)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.read(spark, sf_dir, "documents"))[0].drop("cls")


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(common.read(spark, sf_dir, "documents")).select("doc_id", "n_links")
