"""Mixing sources to target weights by entropy balancing.

Targets: the sources in code point order (null last) weigh 3, 1, 2, 3, ...;
they share ``share`` times all sizes, none gets more than ``cap`` times its
own size, and the excess is shared again by weight (water filling).

Rates: among all document rates in (0, cap), those closest to the uniform
rate cap / 2 in (binary) entropy that meet the token constraint of the source
are tilted exponentially by length: rate = cap * t / (1 + t) with
t = exp(lambda * size / mean size). The convex dual has one lambda a source;
safeguarded Newton steps solve all sources at once, each step one aggregation
over the (source, size) counts. Rates depend on source and size alone, so the
counts, not the documents, carry the iterations.

Rounding: floor(rate) copies, and one more for a part of the documents that a
systematic walk over the sizes fixes. The walk is tried from ``STARTS`` start
points; per source the one whose tokens come closest to the target is used,
and up to ``FIXES`` single copies are added or taken to close what is left.

Documents with null or empty text have size 0 and take nothing. Repeated rows
each have their own copies; the result does not depend on row order. Sources
without words have target 0. Null ids are ids like any other; a text of any
length counts by its words. An empty table gives no rows. Other columns don't
matter to ``mix``; ``apply`` carries them along whatever their names.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
STEPS = 40
TOLERANCE = 1e-7
STARTS = 64
FIXES = 3
SALTS = 64


def sized(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(common.WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))


def targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: sid, source, source_size, rows, target."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # One row per source from here on; the global order of sources needs one sort.
    by = by.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", weight.cast("double")).withColumn(
        "limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    every, full = W.partitionBy(), W.orderBy("ratio", "sid").rowsBetween(W.unboundedPreceding, -1)
    by = by.withColumn("level", (
        F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(full), F.lit(0.0))
    ) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    # The sources with a ratio under their level are full; the level of the first that is not holds for the rest.
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    return by.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("weight") * level, F.col("limit")))).select(
        "sid", "source", "source_size", "n", "target")


def _rate(lam: Column, size: Column, mean: Column, cap: int) -> Column:
    return F.lit(float(cap)) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * size / mean))))


def solve(counts: DataFrame, goals: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Newton iterations for the dual; one row per source: sid, mean, lam, full."""
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("n")).otherwise(F.lit(1.0))
    state = goals.select(
        "sid", "target", mean.alias("mean"), (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit(1.0).alias("miss"))
    state = common.cut(state, "mix-state")
    for _ in range(steps):
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        sums = counts.join(state.where(~F.col("full")), "sid").groupBy("sid").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("slope"))
        miss = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.least(F.lit(8.0), F.greatest(F.lit(-8.0), -miss / F.col("slope")))
        step = F.when(F.col("slope") > 0, step).otherwise(F.when(miss > 0, -8.0).when(miss < 0, 8.0).otherwise(0.0))
        nxt = F.col("lam") + step
        inside = (nxt > F.coalesce(lo, F.lit(float("-inf")))) & (nxt < F.coalesce(hi, F.lit(float("inf"))))
        nxt = F.when(inside | lo.isNull() | hi.isNull(), nxt).otherwise((lo + hi) / 2)
        state = common.cut(state.join(sums, "sid", "left").select(
            "sid", "target", "mean", "full", F.when(miss == 0, F.col("lam")).otherwise(nxt).alias("lam"),
            lo.alias("lo"), hi.alias("hi"),
            F.when(F.col("target") > 0, F.abs(miss) / F.col("target")).otherwise(0.0).alias("miss")), "mix-state")
        if (state.where(~F.col("full")).agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state


def _fix(placed: DataFrame, cap: int) -> DataFrame:
    """Per source, one copy more or less of one document whose size comes
    closest to what the rounding left over or took too much."""
    taken = F.col("size") * (F.col("base") * F.col("n") + F.col("extra"))
    rest = placed.groupBy("sid").agg((F.first("target") - F.sum(taken)).alias("rest"))
    d = placed.join(rest, "sid")
    more = (F.col("rest") > 0) & (F.col("extra") < F.col("n")) & (F.col("base") < cap)
    less = (F.col("rest") < 0) & (F.col("extra") > 0)
    after = F.abs(F.abs(F.col("rest")) - F.col("size"))
    step = d.where((more | less) & (after < F.abs(F.col("rest")))).groupBy("sid").agg(
        F.min(F.struct(after.alias("after"), "size")).alias("m"), F.first(F.signum("rest")).alias("sign"))
    step = step.select("sid", F.col("m.size").alias("size"), F.col("sign").cast("long").alias("step"))
    return placed.join(step, ["sid", "size"], "left").withColumn(
        "extra", F.col("extra") + F.coalesce("step", F.lit(0))).drop("step")


def mix(docs: DataFrame, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row."""
    rows = common.cut(sized(docs), "mix-rows")
    goals = common.cut(targets(rows, share, cap), "mix-goals")
    sid = rows.join(goals.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")
    keyed = common.cut(sid.withColumn("salt", salt), "mix-keyed")
    cells = common.cut(keyed.groupBy("sid", "size", "salt").agg(F.count("*").alias("n")), "mix-cells")
    counts = common.cut(cells.groupBy("sid", "size").agg(F.sum("n").alias("n")), "mix-counts")
    state = solve(counts, goals, cap)

    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
    walk = W.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)
    plan = counts.join(state, "sid").withColumn("rate", rate).withColumn("base", F.floor("rate")).withColumn(
        "part", (F.col("rate") - F.col("base")) * F.col("n")).withColumn("upto", F.sum("part").over(walk))
    plan = common.cut(plan.select("sid", "size", "n", "target", "base", "part", "upto"), "mix-plan")

    def extra(start: Column) -> Column:
        return F.floor(F.col("upto") + start) - F.floor(F.col("upto") - F.col("part") + start)

    tried = plan.groupBy("sid", "target").agg(*[
        F.sum(F.col("size") * (F.col("base") * F.col("n") + extra(F.lit(k / STARTS)))).alias(f"t{k}") for k in range(STARTS)])
    best = tried.select("sid", F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("miss"), F.lit(k / STARTS).alias("start"))
        for k in range(STARTS)]))["start"].alias("start"))
    placed = common.cut(plan.join(best, "sid").withColumn("extra", extra(F.col("start")).cast("long")), "mix-placed")
    for _ in range(FIXES):
        placed = common.cut(_fix(placed, cap), "mix-placed")
    # Which documents of a (source, size) group get the extra copy: the first ones by salt, then id.
    before = W.partitionBy("sid", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    chosen = cells.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(
        placed.select("sid", "size", "base", "extra"), ["sid", "size"])
    chosen = chosen.select("sid", "size", "salt", "base", (F.col("extra") - F.col("skip")).alias("extra"))
    rank = F.row_number().over(W.partitionBy("sid", "size", "salt").orderBy("doc_id", "key"))
    copies = (F.col("base") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("long")
    return keyed.withColumn("rank", rank).join(chosen, ["sid", "size", "salt"]).join(
        goals.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    docs, names, known = *common.aside(docs, "doc_id", "text", "source"), docs.columns
    taken = common.cut(mix(docs).groupBy("doc_id", "key").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-copies")
    d = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    if not taken.where("rows > 1").isEmpty():  # repeated rows: one of them stands for all
        d = d.dropDuplicates(["doc_id", "__key"])
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("copies").alias("__copies"))
    d = d.join(common.broadcast_if_small(taken, 32), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    return d.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*names).toDF(*known)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")
