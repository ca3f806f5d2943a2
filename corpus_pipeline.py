"""The corpus pipeline: documents to token ids in five stages.

Each stage works on the documents its predecessor kept, written as Parquet and
read again. All but the last return the columns of ``documents``; the last
returns ids and the text they decode to. Near duplicates are groups linked by
five-word shingles at a similarity of 0.8 or more.

Every stage takes an empty table to an empty one, treats rows, not ids, as
documents (ids may repeat or be null), and carries other columns along whatever
their names. A text must fit its task some times over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import bpe, common, mixing, ngram_join, quality, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base and line rules, without the lines above the limits.
    Null and empty texts fail; rows equal in id and text share a verdict."""
    common.ship(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, that of the smallest id (null ids last, then by text
    hash; of repeated rows one). Rows without words are in no group and stay."""
    common.ship(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the words of windows that occur earlier (null ids come last and
    are not earlier than each other); rows of which nothing stays go, null texts stay null."""
    common.ship(spark)
    return substring_dedup.strip(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; null and empty texts have size 0 and
    are not taken. Repeated rows have copies of their own."""
    common.ship(spark)
    return mixing.apply(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text they decode to, of every row; null and empty
    texts have no ids. (The last stage: other columns end here.)"""
    common.ship(spark)
    both = bpe.encode_and_decode(docs)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

ORACLE_SQL = None  # rates of the mix and token ids are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
