"""Steps whose tables grow with the documents stay out of the driver and of second Python workers."""

from __future__ import annotations

import pytest

from shelfwise.llm import common, ngram_join, suffix_dedup, token_files


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def written(monkeypatch):
    """Plans of the tables that are stored, by name."""
    plans, real = {}, common._write

    def write(df, name, by=()):
        plans[name] = _plan(df)
        return real(df, name, by)

    monkeypatch.setattr(common, "_write", write)
    return plans


def _docs(spark):
    text = "one two three four five six seven eight nine ten"
    return spark.createDataFrame([(1, text), (2, text + " eleven"), (3, None), (None, text)], "doc_id long, text string")


def test_words_and_blocks_are_gone_when_the_files_are_written(spark, written, monkeypatch):
    import os

    folders, real = {}, common.work_folder
    monkeypatch.setattr(common, "work_folder", lambda s, name: folders.setdefault(name, real(s, name)))
    seen, write = {}, common._write

    def watch(df, name, by=()):
        seen[name] = [n for n, f in folders.items() if os.path.exists(f.removeprefix("file:")) and os.listdir(f.removeprefix("file:"))]
        return write(df, name, by)

    monkeypatch.setattr(common, "_write", watch)
    token_files.write(_docs(spark), real(spark, "tokens"))
    assert "bpe-words" in seen["token-rows"] and "token-rows" in seen["token-files"]
    assert not {"bpe-words", "bpe-blocks"} & set(seen["token-files"])


def test_token_rows_are_packed_where_the_ids_are_made(spark, written):
    folder = common.work_folder(spark, "tokens")
    back = token_files.read_back(token_files.write(_docs(spark), folder), folder)
    assert sorted(r.n_tokens for r in back.collect())[0] == 1 and back.count() == 4
    assert "FlatMapCoGroupsInArrow" in written["token-rows"] and "MapInArrow" not in written["token-rows"].replace("FlatMapCoGroupsInArrow", "")


def test_shared_shingles_meet_without_the_driver(spark):
    sets = {b"a": [1, 2, 3], b"b": [3, 2, 9], b"c": [7]} | {bytes([100 + i]): [5, 50 + i] for i in range(ngram_join.LARGE + 1)}
    prefix = spark.createDataFrame(
        [(i, bytearray(c), 10, 1, t) for i, (c, t) in enumerate(sets.items())], "number long, cls binary, n long, l int, prefix array<long>")
    entries = ngram_join.shared_entries(prefix)
    held = [t for ts in sets.values() for t in ts]
    expected = {(c, at, t, held.count(t) > ngram_join.LARGE) for c, ts in sets.items() for at, t in enumerate(ts) if held.count(t) > 1}
    assert {(bytes(r.cls), r.at, r.token, r.large) for r in entries.collect()} == expected
    assert "Broadcast" not in _plan(entries)


def test_join_of_near_copies_broadcasts_no_shingles_of_pairs(spark, written):
    rows, _ = ngram_join.join(_docs(spark), percent=70)
    assert {(r.doc_id, r.component_id) for r in rows.collect()} == {(1, 1), (2, 1), (None, 1), (3, 3)}
    assert "ngram-often" not in written and "Broadcast" not in written["ngram-entries"]


def test_texts_meet_their_places_by_a_shuffle_at_any_size(spark):
    texts = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "ord long, key long, text string")
    info = spark.createDataFrame([(1, 10, bytearray(b"\0\0\0\0"))], "ord long, key long, places binary")
    met = suffix_dedup._placed(texts, info)
    assert [(r.ord, r.text) for r in met.collect()] == [(1, "a")]
    assert "SortMergeJoin" in _plan(met) and "Broadcast" not in _plan(met)
