"""Queries of the training-data operators, by name."""

from __future__ import annotations

from shelfwise.llm import (
    bpe, fill_middle, language_id, lexical_search, mixing, ngram_join, oracle, quality, sharding, substring_dedup, suffix_dedup,
    token_files, topk, warc,
)

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op2_ngram_links": ngram_join.op2_ngram_links,
    "op3_sharding": sharding.op3_sharding,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_warc": warc.op5_warc,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_topk": topk.op8_topk,
    "op9_token_files": token_files.op9_token_files,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_language_id": language_id.op11_language_id,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL = oracle.SQL
