"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of virtual slots; rows and bytes are
summed per slot; a versioned table maps slots to shards. Version 0 deals the
slots round robin. ``rebalance`` edits the newest version: every shard keeps
its largest slots up to the mean load, the rest go one by one, largest first,
to the shard with the least bytes. Only those slots change their shard.

Everything is DataFrame operations. The slot table has at most ``slots`` rows,
so it may be broadcast and its edit may run in one task.

Null texts count as empty, null ids hash as null. Repeated rows fall into one
slot and get places of their own. An empty table gives no rows and a map
without bytes. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import common

SLOTS = 8192
SHARDS = 16


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slots)).cast("int"))


def first_map(spark: SparkSession, stats: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: every slot, used or not, dealt round robin."""
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(F.broadcast(stats), "vslot", "left").select(
        F.lit(0).alias("version"), "vslot", (F.col("vslot") % shards).cast("int").alias("shard"),
        F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rebalance(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version of the map for ``shards`` shards; moves as few slots as the
    mean load allows. ``slot_map`` holds one version."""
    mean = F.sum("bytes").over(W.partitionBy()) / shards
    order = W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    judged = slot_map.withColumn("mean", mean).withColumn(
        "load", F.sum("bytes").over(order.rowsBetween(W.unboundedPreceding, 0)))
    stays = (F.col("load") <= F.col("mean")) & (F.col("shard") < shards)
    judged = judged.withColumn("stays", stays)
    state = judged.agg(
        *[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == s), F.col("bytes"))), F.lit(0))
          .cast("long").alias(f"l{s}") for s in range(shards)],
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "vslot"))), asc=False).alias("pool"))
    state = state.select("pool", F.array(*[f"l{s}" for s in range(shards)]).alias("loads"))

    def place(acc, slot):
        best = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == best, x + slot["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["moved"], F.array(F.struct(slot["vslot"].alias("vslot"), best.alias("to")))).alias("moved"))

    empty = F.array().cast("array<struct<vslot:int,to:int>>")
    moved = state.select(F.explode(F.aggregate(
        "pool", F.struct(F.col("loads"), empty.alias("moved")), place)["moved"]).alias("m"))
    moved = moved.select("m.vslot", "m.to")
    return slot_map.join(F.broadcast(moved), "vslot", "left").select(
        (F.col("version") + 1).alias("version"), "vslot",
        F.coalesce("to", "shard").cast("int").alias("shard"), "bytes", "n")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(rows with shard and place in it, all versions of the map).

    ``slot`` numbers the rows of a shard from 0 without gaps: by virtual slot,
    then id. The numbering runs per virtual slot and adds the rows of the
    slots before it, so no task holds a whole shard.
    """
    rows = common.cut(records(docs, slots), "shard-rows")
    stats = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    v0 = common.cut(first_map(docs.sparkSession, stats, shards, slots), "slot-map")
    v1 = common.cut(rebalance(v0, shards), "slot-map")
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    place = v1.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    out = rows.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(place), "vslot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
    return out, v0.unionByName(v1)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"))[0]
