"""Work of token files: rare pairs are not counted one by one, and a task reads several files."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from shelfwise.llm import common, token_files


def test_rare_pairs_are_left_out_before_pairs_are_counted(monkeypatch):
    rng = np.random.default_rng(3)
    first = np.repeat(np.arange(2000), 20)  # 2,000 pairs of 20 places each, with rare neighbours
    rng.shuffle(first)
    ids = np.stack([10 + first, 5000 + first, rng.integers(10_000, 60_000, len(first))], 1).reshape(-1)
    counted, array = [], pa.array

    def watch(a, *args, **kw):
        counted.append(len(a) if getattr(a, "dtype", None) == np.uint64 else 0)
        return array(a, *args, **kw)

    monkeypatch.setattr(pa, "array", watch)
    ends = np.asarray([0, 9, 9, 30_000, len(ids)])
    data = token_files.dump([1, 2, 3, 4, 5], ends, ids)
    monkeypatch.undo()
    f = token_files.TokenFile(data)
    assert len(f.rules) >= 2000 and (f.read_all() == ids).all() and f.ends.tolist() == ends.tolist()
    assert len(first) <= sum(counted) < 1.5 * len(first)


def test_rules_stay_in_their_document():
    """Pairs at the ends of documents of one or no id, at the start, and in runs of one id."""
    rng = np.random.default_rng(6)
    for _ in range(200):
        docs = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 60)) for _ in range(rng.integers(1, 30))]
        f = token_files.TokenFile(token_files.dump(list(range(len(docs))), np.cumsum([len(d) for d in docs]), np.concatenate(docs)))
        assert [f.read_document(i).tolist() for i in range(len(docs))] == [d.tolist() for d in docs]
        assert f.read_all().tolist() == np.concatenate(docs).tolist()


def test_a_task_reads_several_files(spark):
    rows = [(i, f"word{i} and more") for i in range(9)] + [(None, None)]
    folder = common.work_folder(spark, "test-token-tasks")
    index = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, shard_tokens=1)
    assert index.count() == len(rows)  # a file for each document
    back = token_files.read_back(index, folder)
    assert back.rdd.getNumPartitions() == -(-len(rows) // 4)
    got = sorted(back.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *range(9)]
    assert got[0].n_tokens == 1 and got[0].ids_crc32 == zlib.crc32(np.asarray([1], "<u4"))
    assert [r.start for r in got[1:]] == np.cumsum([r.n_tokens for r in got])[:-1].tolist()
