"""Exact top-k inner product search by columnar branch and bound.

Vectors are laid out dimension by dimension. Queries are taken in blocks of
about ``QUERY_BLOCK``; a block meets the stored candidates in one pass. In a
task, scores grow by one block of dimensions at a time; what the dimensions to
come can still add is at most the product of the remaining norms
(Cauchy-Schwarz). Candidates whose best possible score is under the k-th best
of every query, and queries without candidates, are compacted away before the
next block of dimensions. Each task gives k rows per query, and the best of
those are the result.

Components become floor(256 * x). Missing trailing components count as 0.
Null vectors, and those with a null or non-finite component, take no part;
null ids neither. A query's own rows are those with its id; equal queries in
repeated rows are asked once. Ties go to the smaller id; repeated candidates
keep a place each. Scores must fit a long. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import common

SCALE = 256
TOP = 5
EVERY = 50
QUERY_BLOCK = 1024
DIMENSIONS = 8
CANDIDATES = 4096


def quantised(table: DataFrame) -> DataFrame:
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(good).select("vec_id", F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(values: np.ndarray, ends: np.ndarray, dims: int | None = None) -> np.ndarray:
    """Vertical layout: one row per dimension, one column per vector."""
    n = np.diff(ends)
    d = max(int(n.max()) if len(n) else 0, dims or 0, 1)
    out = np.zeros((d, len(n)), np.int64)
    out[np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], n), np.repeat(np.arange(len(n)), n)] = values
    return out


def remaining(m: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of each column over the dimensions from each cut on."""
    squares = np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    squares = np.vstack([squares, np.zeros((1, m.shape[1]))])
    return np.sqrt(squares[cuts])


class Search:
    """Running top k of one block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, top: int):
        # Dimensions with most mass among the queries first.
        self.order = np.argsort(-(queries.astype(np.float64) ** 2).sum(1), kind="stable")
        self.ids, self.q, self.top = ids, queries[self.order], top
        self.cuts = [*range(0, len(self.order), DIMENSIONS), len(self.order)]
        self.rest = remaining(self.q, self.cuts)
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))  # query row, score, id
        self.least = np.full(len(ids), -np.inf)

    def scores(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query rows, candidate columns, exact scores) of the pairs that survive."""
        width = max(1, int(np.abs(self.q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * len(self.order)
        kind = np.float64 if width < 2 ** 53 else object  # doubles are exact up to there, Python integers beyond
        rows, cols = np.arange(len(self.ids)), np.arange(c.shape[1])
        part, rest = np.zeros((len(rows), len(cols)), kind), remaining(c, self.cuts)
        q, v = self.q.astype(kind), c.astype(kind)
        for b, (lo, hi) in enumerate(zip(self.cuts, self.cuts[1:])):
            part = part + q[lo:hi, rows].T @ v[lo:hi][:, cols]
            reach = part.astype(np.float64) + np.outer(self.rest[b + 1, rows], rest[b + 1, cols]) * (1 + 1e-9)
            alive = reach * (1 + np.sign(reach) * 1e-12) + 1e-6 >= self.least[rows, None]
            r, k = alive.any(1), alive.any(0)
            if r.mean(dtype=float) < 0.9 or k.mean(dtype=float) < 0.9:
                part, rows, cols, alive = part[np.ix_(r, k)], rows[r], cols[k], alive[np.ix_(r, k)]
            if not len(rows) or not len(cols):
                return rows[:0], cols[:0], np.empty(0, np.int64)
        x, y = np.nonzero(alive)
        return rows[x], cols[y], part[x, y]

    def add(self, ids: np.ndarray, m: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            to = at + (CANDIDATES if len(self.best[0]) else 16 * self.top)
            c = np.zeros((len(self.order), min(to, len(ids)) - at), np.int64)
            have = min(len(self.order), m.shape[0])
            c[:have] = m[:have, at:to]
            r, k, s = self.scores(c[self.order])
            other = ids[at:to][k] != self.ids[r]
            self.keep(r[other], s[other].astype(np.int64), ids[at:to][k[other]])
            at = to

    def keep(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        r, s, i = (np.concatenate(x) for x in zip(self.best, (rows, score, ids)))
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        first = np.searchsorted(r, r)
        place = np.arange(len(r)) - first
        self.best = tuple(x[place < self.top] for x in (r, s, i))
        full = self.best[0][np.flatnonzero(np.arange(len(self.best[0])) - np.searchsorted(self.best[0], self.best[0]) == self.top - 1)]
        at = np.flatnonzero(np.arange(len(self.best[0])) - np.searchsorted(self.best[0], self.best[0]) == self.top - 1)
        self.least[full] = self.best[1][at]


def _task(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, top)
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                search.add(batch.column("vec_id").to_numpy(), matrix(v.flatten().to_numpy(), v.offsets.to_numpy().astype(np.int64)))
        r, s, i = search.best
        yield pa.RecordBatch.from_arrays([pa.array(search.ids[r]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, every: int = EVERY, top: int = TOP, block: int = QUERY_BLOCK) -> DataFrame:
    spark = table.sparkSession
    vectors = common.cut(quantised(table), "vectors")
    queries = common.cut(vectors.where(F.col("vec_id") % every == 0).distinct(), "vector-queries")
    blocks = max(1, -(-queries.count() // block))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts = None
    for b in range(blocks):  # a block's result is written and its broadcast let go before the next
        held = queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow().combine_chunks()
        v = held.column("v").combine_chunks() if held.num_rows else None
        if v is None:
            continue
        m = matrix(v.flatten().to_numpy(), v.offsets.to_numpy().astype(np.int64))
        shared = spark.sparkContext.broadcast((held.column("vec_id").to_numpy(), m))
        got = vectors.mapInArrow(_task(shared, top), "query_id bigint, vec_id bigint, score bigint")
        got = common.cut(got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top), "vector-best")
        shared.unpersist()
        del shared, held, m
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        parts = spark.createDataFrame([], "query_id bigint, vec_id bigint, score bigint, rank int")
    return parts.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"))
