"""Quality rules with cross-document line frequency.

Base rules of a document: its words, its repeated lines and the words inside
repeated three-word windows. Line rule: every line is normalised (lower case,
white space to one blank), hashed, and the distinct texts
that hold it are counted per host (here: the source). A line in more than
``LINE_LIMIT`` texts of its host is removed from all documents but the one
with the smallest id there. A document left with under ``KEPT_PERCENT`` percent
of its words is depleted and rejected.

Copies of one text count once, so a text is not rejected for being copied.
Null texts have no words and fail the base rules; null hosts form a host of
their own. Rows equal in id and text share one verdict, given for each row.
A very long text is one row of word and line arrays, which must fit its task
some times over. An empty table gives no rows. Other columns don't matter to
``judge``; ``keep_good`` carries them along whatever their names.
Everything is DataFrame operations; text is never shuffled, only hashes are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import common

MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_LIMIT = 20
KEPT_PERCENT = 30
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and bind it in ``body``."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array."""
    def grams(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                           lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]))

    def covered(g: Column) -> Column:
        order = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(order, lambda s: _let(
            F.sort_array(F.transform(
                F.filter(F.transform(s, lambda x, j: F.struct(
                    x["i"].alias("i"),
                    (F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
                     | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))).alias("twice"))),
                    lambda x: x["twice"]), lambda x: x["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"), lambda a, x: a + x)))

    return _let(words, lambda w: _let(grams(w), lambda g: F.when(
        F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g))))


def keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(2 ** 63)))).withColumn("__text", F.xxhash64(text))


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, common.SPACE, " ")))


def with_word(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def base(docs: DataFrame) -> DataFrame:
    """Measures of every row and the base verdict."""
    text, w = F.coalesce(F.col("text"), F.lit("")), F.col("w")
    d = keys(docs).select(
        "doc_id", "__id", "__text", common.words_of(text).alias("w"), with_word(text).alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    d = d.select(
        "doc_id", "__id", "__text", F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))


def lines(docs: DataFrame) -> DataFrame:
    """One row per (distinct row, distinct normalised line): hash and words."""
    one = F.transform(with_word(F.col("text")), lambda x: F.struct(
        F.xxhash64(normal_line(x)).alias("h"), F.size(common.words_of(x)).alias("n")))
    d = keys(docs).select(F.col("source").alias("host"), "__id", "__text", F.explode(one).alias("l"))
    return d.groupBy("host", "__id", "__text", F.col("l.h").alias("h")).agg(F.sum("l.n").alias("n"))


def frequent(per_doc: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """Lines above the limit of their host, and the document that keeps each."""
    text = per_doc.groupBy("host", "h", "__text").agg(F.min("__id").alias("__id"))
    return text.groupBy("host", "h").agg(
        F.count("*").alias("texts"), F.min(F.struct("__id", "__text")).alias("first")).where(F.col("texts") > limit)


def removed_lines(per_doc: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """(row key, line hash, words) of every line that is taken out of a row.
    Rows with the text that keeps the line keep it as well."""
    bad = frequent(per_doc, limit).select(F.col("host").alias("b_host"), F.col("h").alias("b_h"), "first")
    same = F.col("host").eqNullSafe(F.col("b_host")) & (F.col("h") == F.col("b_h"))
    return per_doc.join(bad, same).where(F.col("first.__text") != F.col("__text")).select("__id", "__text", "h", "n")


def judge(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdict of every row, lines taken out). The line table is written once."""
    out = common.cut(removed_lines(common.cut(lines(docs), "quality-lines")), "quality-removed")
    gone = out.groupBy("__id", "__text").agg(F.sum("n").alias("n_line_words"))
    d = base(docs).join(gone, ["__id", "__text"], "left")
    lost = F.coalesce("n_line_words", F.lit(0))
    depleted = (F.col("n_words") - lost) * 100 < F.col("n_words") * KEPT_PERCENT
    return d.select("doc_id", "__id", "__text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"),
                    lost.cast("long").alias("n_line_words")), out


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "documents"))[0].drop("__id", "__text")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with the lines above the limits taken out of the text."""
    docs, names, known = *common.aside(docs, "doc_id", "text", "source", "n_chars"), docs.columns
    verdict, out = judge(docs)
    good = verdict.where("kept").select("__id", "__text").distinct()
    gone = out.groupBy("__id", "__text").agg(F.collect_set("h").alias("__gone"))
    d = keys(docs).join(good.join(gone, ["__id", "__text"], "left"), ["__id", "__text"])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("__gone", F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    n_chars = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return d.withColumn("n_chars", n_chars).withColumn("text", text).select(*names).toDF(*known)
