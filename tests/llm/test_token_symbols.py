"""Symbols of a token file take the bits they need, a file is read by spelling every rule once, and words
that differ in their marks only are encoded once."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import bpe, common, token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.mark.parametrize("top, most", [(60_000, 2.1), (70_000, 2.3), (200_000, 2.5)])
def test_symbols_take_the_bits_they_need(top, most):
    ids = np.random.default_rng(1).integers(0, top, 40_000)
    ends = np.asarray([10, 10, 39_999, 40_000])
    data = token_files.dump([1, None, 3, 4], ends, ids)
    assert len(data) < most * len(ids)
    f = token_files.TokenFile(data)
    assert (f.read_all() == ids).all() and f.doc_ids == [1, None, 3, 4]
    assert [f.read_document(i).tolist() for i in (0, 1, 3)] == [ids[:10].tolist(), [], ids[39_999:].tolist()]
    assert f.read_ids(2, 500, 900).tolist() == ids[510:910].tolist()


def test_files_are_read_whole_by_the_rules():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 70_000, 6) for _ in range(300)]
    docs = [np.concatenate([words[i] for i in rng.integers(0, 300, 200)]) for _ in range(20)]
    for case in (docs, [np.full(5000, 7)], [np.arange(9)], [np.empty(0, np.int64)]):
        ids, ends = np.concatenate(case), np.cumsum([len(d) for d in case])
        f = token_files.TokenFile(token_files.dump(list(range(len(case))), ends, ids))
        assert (f.read_all() == ids).all() and len(f.read_all()) == len(ids)
        pairs = np.stack([f.seq[:-1], f.seq[1:]], 1)[np.isin(np.arange(len(f.seq) - 1) + 1, f.sym_ends, invert=True)] if len(f.seq) > 1 else np.empty((0, 2))
        # No pair inside a document stays frequent.
        assert not len(pairs) or np.unique(pairs, axis=0, return_counts=True)[1].max() < token_files.LEAST


def test_rows_are_packed_with_their_end_id():
    ids, ends = np.asarray([5, 70_000, 9, 9], np.int32), np.asarray([0, 0, 2, 4])
    rows = token_files._packed(pa.array([1, 2, 3], pa.int64()), ids, ends).to_pylist()
    assert [(r["doc_id"], r["n"], token_files.unpack(r["packed"]).tolist(), r["packed"][0]) for r in rows] == [
        (1, 1, [1], 2), (2, 3, [5, 70_000, 1], 4), (3, 3, [9, 9, 1], 2)]


def test_marks_and_case_do_not_make_more_words():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["abc abc### ABC*** abc$$$, abc&&&"]})
    _, words, codes, counts = bpe._block(batch)
    assert sorted(words.to_pylist()) == ["###", "$$$,", "&&&", "***", "abc"]
    assert [words[int(c)].as_py() for c in codes] == ["abc", "abc", "###", "abc", "***", "abc", "$$$,", "abc", "&&&"]
    assert counts.tolist() == [9]


def test_words_of_accents_and_marks_equal_the_library(tokenizer):
    rng = random.Random(5)
    alphabet = list("abZéÉßÿÞ×÷µªºĀſ́#*$%&.,'<|> 1")
    text = bpe.Vocabulary().text
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        _, words, codes, _ = bpe._block(pa.RecordBatch.from_pydict({"doc_id": [1], "text": [t]}))
        flat, lens = bpe.encode_words(text, words) if len(words) else (np.empty(0, int), np.empty(0, int))
        starts = np.cumsum(lens) - lens
        got = flat[common.ranges(starts[codes], lens[codes])].tolist() if len(words) else []
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
