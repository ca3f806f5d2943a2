"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over links (u, v). Large: a node hands its smallest
    neighbour to the larger ones; small: to the smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where(F.col("v") < F.col("u")) if small else both
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    side = near if small else both.where(F.col("v") > F.col("u"))
    out = side.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of a link table (u, v); the root is the
    smallest node of its component. Each round is written to the shared folder."""
    links = common.cut(edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(links)
    while before[0]:
        links = common.cut(_star(_star(links, False), True), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
