"""Token ids: texts are decoded where their ids are made."""

from __future__ import annotations

import pytest

from shelfwise.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


TEXTS = ["One two, three!", "Éa éA ß*** ÿ### don't <|endoftext|>", "", None, " \n", "words&&& 12 words%%% ÀÖ;:"]


def test_texts_are_decoded_where_their_ids_are_made(spark, tokenizer):
    import corpus_pipeline

    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = corpus_pipeline.token_ids(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan
    want = {}
    for i, t in enumerate(TEXTS):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i or None] = (len(ids), ids, tokenizer.decode(ids, skip_special_tokens=False))
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in out.collect()} == want


def test_decode_leaves_unknown_ids_out_and_keeps_null(spark):
    pieces = bpe.Vocabulary().pieces
    rows = [(1, [5, -1, 10**6, None, 7]), (2, []), (3, None), (4, [10**6])]
    got = bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {
        1: (rows[0][1], f"{pieces[5]} {pieces[7]}"), 2: ([], ""), 3: (None, None), 4: ([10**6], "")}
