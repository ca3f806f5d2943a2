"""Each training-data operator against a brute-force version on small tables
with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import (
    bpe, common, induced, mixing, ngram_join, quality, sharding, substring_dedup, suffix_dedup, token_files, topk, warc,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, ord string, tokens string"


def _texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "δέλτα", "été", "x1", "don't", "ÀB.", "<|endoftext|>", "naïve!", "中文", "a b", "ﬁn"]
    words += [f"w{i}" for i in range(150)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(60, 200))) for _ in range(12)]
    near = []
    for b in base[:6]:
        w = b.split(" ")
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = f"new{rng.randrange(999)}"
            near.append(" ".join(v))
    shared = " ".join(f"s{i}" for i in range(60))
    mixed = [f"{b[:200]}\n{shared}\n{b[300:500]}" for b in base]
    edge = [None, "", " \t\n", "one", "two words", "Two WORDS", "a b c", "same line\nsame line\nother", shared + " " + shared,
            " ".join(f"long{i % 977}" for i in range(20_000)), "x" * 5000, "\x00 nul \x00 nul"]
    return base + base[:4] + near + mixed + edge


def _rows():
    out = [(i, t, "en", None if i % 5 == 0 else f"src{i % 4}", len(t or ""), "k", "o", "t") for i, t in enumerate(_texts())]
    return out + [out[2], out[2], (None, out[3][1], None, None, None, "k", "o", "t"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return common.cut(spark.createDataFrame(_rows(), SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    common.ship(spark)
    return common.cut(spark.createDataFrame([], SCHEMA), "test-empty")


def _plain(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def test_bpe_equals_the_library(docs, empty, tokenizer):
    got = _plain((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs)).collect())
    want = []
    for d, t, *_ in _rows():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((d, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == _plain(want)
    assert bpe.decode(bpe.encode(empty)).count() == 0


def test_white_space_cuts_are_exact(tokenizer):
    import pyarrow as pa

    rng = random.Random(3)
    alphabet = list("aZé,.!'<|>1́  İßſΣ中 \t\n\x0b\x0c\r") + ["<|startoftext|>"]
    text = bpe.Vocabulary().text
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [t]})
        _, words, codes, _ = bpe._block(batch)
        flat, lens = bpe.encode_words(text, words) if len(words) else (np.empty(0, int), np.empty(0, int))
        starts = np.cumsum(lens) - lens
        got = flat[common.ranges(starts[codes], lens[codes])].tolist() if len(words) else []
        assert got == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def _shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(docs, empty, k, percent):
    rows = _rows()
    sets = [_shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((r[0], len(sets[i]), min(ids) if ids else None))
    got = _plain(ngram_join.join(docs, k, percent)[0].drop("cls").collect())
    assert got == _plain(want)
    assert ngram_join.join(empty)[0].count() == 0


def test_large_group_of_near_copies_is_one_component(spark):
    """More near copies than a small bucket holds, each with words of its own, and texts that share half of them."""
    rng = random.Random(5)
    w = [f"t{i}" for i in range(120)]
    texts = [" ".join(w)]
    for i in range(80):
        v = list(w)
        v[rng.randrange(120)] = f"n{i}"
        texts.append(" ".join(v))
    texts += [" ".join(w[:60] + [f"o{i}x{j}" for j in range(60)]) for i in range(40)]
    df = common.cut(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "test-near")
    got = {r.doc_id: r.component_id for r in ngram_join.join(df, 3, 90)[0].collect()}
    assert all(got[i] == 0 for i in range(81)) and all(got[i] == i for i in range(81, 121))


def _groups(rows, k, percent):
    """Root of every row with shingles, None for the others, by all pairs."""
    sets = [_shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) if sets[i] else None for i in range(len(rows))]


def _holds_one_of_each_group(got, rows, k, percent):
    """Every row without shingles, and of each group one row of its smallest id."""
    group, left = _groups(rows, k, percent), list(got)
    for i, g in enumerate(group):
        if g is None:
            left.remove(rows[i])
    for g in {g for g in group if g is not None}:
        own = [r for r, h in zip(rows, group) if h == g]
        ids = [r[0] for r in own if r[0] is not None]
        least = [r for r in own if r[0] == (min(ids) if ids else None)]
        hits = [r for r in left if r in least]
        assert len(hits) == 1, (g, len(hits))
        left.remove(hits[0])
    assert not left


def test_near_duplicate_stage_keeps_unlinked_texts_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"q{rng.randrange(10 ** 6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, text(), "x") for _ in range(12)]
    rows += [(None, c, "x"), (None, c + " more", "x"), (None, c, "x")]  # a group of null ids only
    rows += [(7, a, "x"), (7, b, "x"), (7, a, "x")]  # unlinked texts of one id, one of them twice
    rows += [(1, d, "x"), (9, d + " more", "x"), (9, e, "x"), (None, e + " more", "x")]  # a copy with the id of a row that stays
    rows += [(None, None, "x"), (None, "", "x"), (None, " ", "x"), (7, None, "x"), (7, "", "x"), (7, "", "x")]
    df = common.cut(spark.createDataFrame(rows, "doc_id bigint, text string, key string"), "test-keep")
    got = [tuple(r) for r in ngram_join.keep_one(df).collect()]
    _holds_one_of_each_group(got, rows, 5, 80)


def test_near_duplicate_stage_equals_all_pairs(docs, empty):
    got = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    _holds_one_of_each_group(got, _rows(), 5, 80)
    assert ngram_join.keep_one(empty).count() == 0


def _link_counts(rows, k, percent):
    sets = [_shingles(r[1], k) for r in rows]
    out = []
    for i, (r, s) in enumerate(zip(rows, sets)):
        near = [t for j, t in enumerate(sets) if i != j and s and t and 100 * len(s & t) >= percent * len(s | t)]
        out.append((r[0], len(near), len({frozenset(t) for t in near} - {frozenset(s)})))
    return out


@pytest.mark.parametrize("block", [256, 7])
def test_link_counts_equal_all_pairs(spark, monkeypatch, block):
    """A group above the bucket limit, copies in it, null ids, small groups and texts without a link."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(6)
    w = [f"t{i}" for i in range(120)]
    rows = [(0, " ".join(w))]
    for i in range(1, 60):
        v = list(w)
        for _ in range(rng.randrange(1, 3)):
            v[rng.randrange(120)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((i if i % 9 else None, " ".join(v)))
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[4][1])]
    rows += [(200 + i, " ".join(f"g{i // 3}x{j}" for j in range(60 + i % 3))) for i in range(9)]
    rows += [(300, "alone"), (301, None), (None, ""), (None, "b c d e"), (302, "twice"), (303, "twice")]
    df = common.cut(spark.createDataFrame(rows, "doc_id bigint, text string"), "test-links")
    got = _plain(ngram_join.link_counts(df, 3, 90).collect())
    assert got == _plain(_link_counts(rows, 3, 90))
    assert max(r[1] for r in got) > ngram_join.LARGE


def test_link_counts_equal_sql(spark):
    from shelfwise.llm import queries
    from tests.compare import compare, duck_connection
    from tests.conftest import SMALL_SF

    ok, said = compare(queries.QUERIES["op2_ngram_links"](spark, SMALL_SF), duck_connection(SMALL_SF), queries.ORACLE_SQL["op2_ngram_links"])
    assert ok, said


def test_shards_are_gapless_and_even(docs, empty):
    out, versions = sharding.shard(docs, 4, 64)
    rows = out.collect()
    assert len(rows) == len(_rows())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in _rows())
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    v = {r["version"]: r["n"] for r in versions.groupBy("version").agg(F.sum("bytes").alias("n")).collect()}
    assert v[0] == v[1] == sum(r.size for r in rows)
    assert sharding.shard(empty, 4, 64)[0].count() == 0


def test_rebalancing_moves_few_slots_and_evens_bytes(spark):
    m = spark.createDataFrame([(0, i, i % 4, 100 + 60 * (i % 4 == 0), 1) for i in range(400)],
                              "version int, vslot int, shard int, bytes bigint, n bigint")
    new = sharding.rebalance(m, 4)
    loads = [r[1] for r in new.groupBy("shard").sum("bytes").collect()]
    assert max(loads) - min(loads) <= 160
    moved = new.join(m.select("vslot", F.col("shard").alias("old")), "vslot").where("shard <> old").count()
    assert 0 < moved < 80
    wider = sharding.rebalance(m, 5)
    assert wider.select("shard").distinct().count() == 5


def test_quality_measures(docs, empty):
    verdict, _ = quality.judge(docs)
    got = _plain(verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for d, t, *_ in _rows():
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 2000 else set(range(len(w)))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep),
                     len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    assert got == _plain(want)
    assert quality.judge(empty)[0].count() == 0


def test_frequent_lines_go_but_once(spark):
    line = " ".join(f"b{i}" for i in range(40))
    rows = [(i, f"{line}\n" + " ".join(f"u{i}v{j}" for j in range(60 if i % 2 else 10)), "src", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    kept = {r.doc_id: r.text for r in quality.keep_good(df).collect()}
    assert kept[0] == rows[0][1]  # the first document keeps its line
    assert all(line not in kept[i] for i in range(1, 60, 2))
    assert not any(i in kept for i in range(2, 60, 2))  # under 30 percent stays


def test_mix_meets_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(_rows())
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(r["size"] for r in rows) == sorted(size(t) for _, t, *_ in _rows())
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    total = {s: sum(r["size"] for r in by[s]) for s in names}
    goal, open_, left = {}, dict(zip(names, [3, 1, 2, 3, 1])), 1.5 * sum(total.values())
    while open_:  # share again until none is above its limit
        level = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > 2 * total[s]]
        for s in full or list(open_):
            goal[s] = 2 * total[s] if full else open_[s] * level
        for s in full:
            left -= goal[s]
            del open_[s]
        if not full:
            break
    for s in names:
        assert abs(by[s][0].target - goal[s]) < 1e-6 * max(1, goal[s])
        assert abs(sum(r.taken for r in by[s]) - goal[s]) <= max(0.03 * goal[s], max(r["size"] for r in by[s]) / 2)
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in rows)
    assert _plain(rows) == _plain(mixing.mix(docs).collect())
    assert mixing.mix(empty).count() == 0


def test_archives_read_back(spark):
    pages = [(i, f"http://x/{i % 7}\n", t) for i, t in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é" * 300, "<p>a</p>", "b"] * 9)]
    pages += [(62, None, "zz"), (62, None, "zz"), (None, None, "zz"), (None, None, "q")]
    df = common.cut(spark.createDataFrame(pages, "page_id bigint, url string, html string"), "test-pages")
    folder = common.work_folder(spark, "test-warc")
    got = _plain(warc.read_back(warc.write(df, folder, limit=2000), folder).collect())
    want = []
    for p, _, h in pages:
        ids = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        last = max(ids) if ids else None
        b = (h or "").encode()
        revisit = last is not None and (p is None or p < last)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    assert got == _plain(want)
    none = spark.createDataFrame([], df.schema)
    assert warc.read_back(warc.write(none, folder + "-none"), folder + "-none").count() == 0


def test_archive_starts_with_its_dictionary():
    import zstandard

    samples = [warc.record(i, "http://x", f"<html>page {i} some words".encode() * 20, "response") for i in range(300)]
    words = warc.train(samples, 4096)
    zip_ = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    data = warc.archive_head(words) + b"".join(map(zip_.compress, samples))
    assert data[:4] == bytes.fromhex("5D2A4D18") and words and list(warc.records_of(data, 100)) == samples


def _byte_dedup(rows, w=50):
    first, out = {}, []
    ids = lambda d: 2 ** 63 - 1 if d is None else d
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            first[b[i:i + w]] = min(first.get(b[i:i + w], ids(d)), ids(d))
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if first[b[i:i + w]] < ids(d):
                gone[i:i + w] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_suffix_dedup_equals_brute_force(docs, empty):
    got = _plain((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect())
    assert got == _plain(_byte_dedup(_rows()))
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(200):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 60))
        t = np.tile(t, 3) if trial % 3 == 0 else t
        text, sa = t.tolist(), induced.suffix_array(t)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        prefix = induced.permuted_prefixes(t, sa, 7)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while n < 7 and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert prefix[b] == n


def test_first_ids_tell_zero_bytes_from_ends():
    segments = [b"a" * 49 + b"\0", b"a" * 49 + b"b", b"\0" * 50, b"x" + b"a" * 49, b"a" * 49 + b"\0a"]
    first, ends = suffix_dedup.first_ids(segments, np.array([5, 4, 3, 2, 1]), 50)
    assert first[ends[0]] == 1 and first[ends[1]] == 4 and first[ends[2]] == 3 and first[ends[3]] == 2


def _word_dedup(rows, w=20):
    ids = lambda d: 2 ** 63 - 1 if d is None else d
    docs = sorted({(ids(d), t or "") for d, t, *_ in rows})
    least, gone = {}, {}
    for d, t in docs:
        x = WORD.findall(t)
        for i in range(len(x) - w + 1):
            g = tuple(x[i:i + w])
            least[g] = min(least.get(g, d), d)
    for d, t in docs:
        x, seen = WORD.findall(t), set()
        out = np.zeros(len(x), bool)
        for i in range(len(x) - w + 1):
            g = tuple(x[i:i + w])
            if least[g] < d or g in seen:
                out[i:i + w] = True
            seen.add(g)
        gone[d, t] = (len(x), int(out.sum()), " ".join(y for y, z in zip(x, out) if not z))
    return [(d, *gone[ids(d), t or ""]) for d, t, *_ in rows]


@pytest.mark.parametrize("most", [100_000, 3])
def test_substring_dedup_equals_brute_force(docs, empty, monkeypatch, most):
    """With three rows a group every prefix grows to its full length and is salted."""
    monkeypatch.setattr(substring_dedup.repeated, "__defaults__", (most,))
    got = _plain((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.dedup(docs).collect())
    assert got == _plain(_word_dedup(_rows()))
    if most > 3:
        assert substring_dedup.dedup(empty).count() == 0


def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 20)], 1) for i in range(400)]
    rows += [(i, rows[0][1], 1) for i in range(400, 408)]  # ties
    rows += [(500, None, 1), (550, [1.0, None], 1), (600, [float("nan")], 1), (650, [float("inf")], 1), (None, [1.0], 1),
             (700, [0.5], 1), (700, [0.5], 1), (750, [], 1), (800, [3e7, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = sorted(map(tuple, topk.search(df, block=3).collect()))
    good = [(i, np.floor(256 * np.asarray(v, np.float32).astype(float)).astype(int).tolist()) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in dict(good).items():
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in good if i != q)[:5]
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.search(df.where("false")).count() == 0


def test_token_files_read_back(docs, empty, spark, tokenizer):
    folder = common.work_folder(spark, "test-tokens")
    got = sorted(map(tuple, token_files.read_back(token_files.write(docs, folder, shard_tokens=3000), folder).collect()), key=repr)
    want = sorted((d is not None, d or 0, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for d, t, *_ in _rows())
    at, rows = 0, []
    sizes = {}
    for known, d, ids in want:
        sizes.setdefault((known, d), []).append(len(ids))
    for key in sorted(sizes):
        for n in sorted(sizes[key]):
            rows.append((key[1] if key[0] else None, at, n))
            at += n
    assert sorted(((d, s, n) for d, s, n, _ in got), key=repr) == sorted(rows, key=repr)
    crc = sorted((len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for *_, i in want)
    assert sorted((n, c) for *_, n, c in got) == crc
    assert token_files.read_back(token_files.write(empty, folder + "-none"), folder + "-none").count() == 0


def test_grammar_gives_random_access():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 30, n) for n in (0, 1, 500, 3000, 0, 7)] + [np.tile([5, 6, 7], 900), np.full(1001, 9)]
    ends = np.cumsum([len(d) for d in docs])
    f = token_files.TokenFile(token_files.dump(list(range(len(docs))), ends, np.concatenate(docs)))
    assert len(f.rules) and len(f.seq) < ends[-1] // 2
    assert (f.rule_lengths == token_files.lengths(f.rules, f.first)).all()
    for i, d in enumerate(docs):
        assert f.read_document(i).tolist() == d.tolist()
    assert f.read_ids(3, 1000, 1500).tolist() == docs[3][1000:1500].tolist()
    assert f.read_ids(6, 1, 2000).tolist() == docs[6][1:2000].tolist()


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    d = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.cut(stage(spark, d, ""), "test-stage")
        assert d.columns == docs.columns, name
        assert d.where("key <> 'k' OR ord <> 'o'").count() == 0
    rows = d.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    assert len(out) == len(rows) > 0
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(r.doc_id for r in rows if r.doc_id is not None)


def test_repeated_passages_stage_equals_brute_force(docs):
    got = [tuple(r) for r in substring_dedup.strip(docs).collect()]
    want = []
    for r, (d, n, gone, kept) in zip(_rows(), _word_dedup(_rows())):
        if not gone:
            want.append(r)
        elif gone < n:
            want.append((d, kept, *r[2:4], len(kept), *r[5:]))
    assert _plain(got) == _plain(want)


def test_source_mix_stage_repeats_rows_as_the_mix_says(docs):
    """Texts and multiplicities: every row as often as ``mix`` gives its source, size and id copies."""
    from collections import Counter

    rows = _rows()
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter(tuple(r) for r in mixing.apply(docs).collect())
    assert set(got) <= set(rows)
    by = Counter()
    for r, n in got.items():
        by[r[0], r[3], len(WORD.findall(r[1] or ""))] += n
    assert by == +copies


@pytest.mark.parametrize("name", ["op2_ngram_join", "op4_quality_rules", "op5_warc", "op7_suffix_dedup", "op8_topk", "op10_substring_dedup"])
def test_queries_equal_sql(spark, name):
    from shelfwise.llm import queries
    from tests.compare import compare, duck_connection
    from tests.conftest import SMALL_SF

    ok, said = compare(queries.QUERIES[name](spark, SMALL_SF), duck_connection(SMALL_SF), queries.ORACLE_SQL[name])
    assert ok, said
