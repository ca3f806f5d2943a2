"""Language ID, fill-in-middle and lexical search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import common, fill_middle, language_id, lexical_search
from tests.conftest import MID_SF, SMALL_SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, form string, score double, rank int, codes string, __key string"
EXTRA = (7, "f", 0.5, 1, "c", "k")


def _rows():
    rng = random.Random(8)
    words = ["alpha", "Beta", "beta", "x1", "naïve", "中文", "ÀB", "don't", "a_b", "\x00", "é", "🙂z", "7"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    texts += [None, "", " \n\t", "one", "<P>", "text with <S> in it", "<M", "<P<S>>", "...", "123 456", "é" * 4000, "ab" * 30000, texts[3], texts[3]]
    rows = [(i, t, rng.choice(["en", "de", None]), "s", *EXTRA) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[4], "en", "s", *EXTRA), (None, texts[4], "en", "s", *EXTRA), (None,) * 10, (1, texts[5], None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return common.cut(spark.createDataFrame(_rows(), SCHEMA).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def empty(spark):
    return common.cut(spark.createDataFrame([], SCHEMA), "test-empty")


def _plain(rows):
    return sorted(map(tuple, rows), key=repr)


# --- fill in the middle -----------------------------------------------------

def _fim(doc_id, text, markers=("<P>", "<S>", "<M>"), rate=90, spm_rate=20):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(t)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, s, m = markers
    if not t or any(x in t for x in markers) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, t
    pre, mid, suf = t[:lo], t[lo:hi], t[hi:]
    if h4 % 100 < spm_rate:
        return doc_id, n, "spm", lo, hi - lo, s + suf + p + pre + m + mid
    return doc_id, n, "psm", lo, hi - lo, p + pre + s + suf + m + mid


def test_fill_middle_equals_plain_python(docs, empty):
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert _plain(tuple(r)[:6] for r in got) == _plain(_fim(r[0], r[1]) for r in _rows())
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in _rows())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(empty).count() == 0


def test_fill_middle_of_texts_cut_into_many_segments(monkeypatch):
    monkeypatch.setattr(fill_middle, "SEGMENT_BYTES", 5)
    monkeypatch.setattr(fill_middle, "GROUP_BYTES", 11)
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("aé中🙂 ") for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (81, "")]
    hashes = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i, _ in rows]
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": pa.array([t for _, t in rows], pa.string())} | {
        f"h{k + 1}": [int(h[8 * k:8 * k + 8], 16) for h in hashes] for k in range(4)})
    part = batch.slice(3)  # a slice with an offset into its buffers
    for given, want in ((batch, rows), (part, rows[3:])):
        out = pa.Table.from_batches(fill_middle._transform(fill_middle.MARKERS, 90, 20)(iter([given])))
        assert [tuple(r.values()) for r in out.to_pylist()] == [_fim(i, t) for i, t in want]


def test_fill_middle_with_other_markers_rates_and_seed(docs):
    markers = ("[pre]", "[suf]", "[mid]")
    got = fill_middle.transform(docs, markers, 100, 100).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), markers)).collect()
    assert _plain(tuple(r)[:6] for r in got) == _plain(_fim(r[0], r[1], markers, 100, 100) for r in _rows())
    assert sorted(r.back for r in got) == sorted(r[1] or "" for r in _rows())
    assert {r.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert fill_middle.transform(docs, seed=2).exceptAll(fill_middle.transform(docs)).count() > 0
    for bad in (("<a", "a>", "<b>"), ("<a>", "<a>b", "c"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs, bad)


# --- lexical search ---------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _search(rows, items, top):
    docs = [(d, Counter(_terms(t))) for d, t, *_ in rows if _terms(t)]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        found = []
        for d, c in docs:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = 0
            for t in _terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return _plain(out)


def _items():
    rng = random.Random(5)
    pool = [t for _, t, *_ in _rows() if t and len(t) < 1000]
    items = [(i, " ".join(rng.choice(pool).split(" ")[:9])) for i in range(30)]
    return items + [(30, None), (31, ""), (32, "..."), (33, "unknown terms only"), (34, "BETA beta Beta"), items[0], items[0], (0, "w1 w2"), (None, "w3 w3")]


@pytest.fixture(scope="module")
def items(spark):
    return common.cut(spark.createDataFrame([(*r, "x", 1) for r in _items()], "item_id bigint, text string, doc_id string, score int"), "test-items")


@pytest.mark.parametrize("cells, vocabulary, first", [(4 << 20, 16 << 20, 20_000), (60, 16 << 20, 5), (4 << 20, 300, 20_000)])
def test_search_equals_brute_force(docs, items, monkeypatch, cells, vocabulary, first):
    """Also with several blocks of items and starting thresholds, and with several groups of terms."""
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "VOCABULARY_BYTES", vocabulary)
    monkeypatch.setattr(lexical_search, "FIRST_DOCS", first)
    got = _plain(lexical_search.search(docs, items, 5).collect())
    assert got == _search(_rows(), _items(), 5)


def test_search_over_nothing(docs, items, empty):
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(docs, items.where("false")).count() == 0
    assert lexical_search.search(docs, items.where("item_id >= 30 and item_id <= 33")).count() == 0


def test_walk_prunes_whole_batches_and_stays_exact():
    """Documents of 40 topics: most node pairs are left out, and the result is that of all products."""
    rng = np.random.default_rng(3)
    n_docs, n_items, n_terms = 6000, 40, 800
    codes = [np.unique(rng.integers(20 * (i % 40), 20 * (i % 40) + 20, 12)) for i in range(n_docs)]
    value = [rng.integers(1, 1000, len(c)) for c in codes]
    item = np.repeat(np.arange(n_items), 10)
    code = (20 * item + rng.integers(0, 20, len(item))).astype(np.int64)
    weight = rng.integers(1, 500, len(item))
    tree = lexical_search.ItemTree(item, code, weight)
    walk = lexical_search.Walk(tree, np.zeros(n_items, np.int64), 5)
    to_block = np.full(n_terms, -1)
    to_block[tree.codes] = np.arange(len(tree.codes))
    dense = np.zeros((n_docs, n_terms), np.int64)
    for i, (c, v) in enumerate(zip(codes, value)):
        dense[i, c] = v
    for at in range(0, n_docs, 1000):
        row = np.repeat(np.arange(1000), [len(c) for c in codes[at:at + 1000]])
        flat, part = to_block[np.concatenate(codes[at:at + 1000])], np.concatenate(value[at:at + 1000])
        known = flat >= 0
        walk.add(np.arange(at, at + 1000), np.zeros(1000, bool), row[known], flat[known], part[known])
    asked = np.zeros((n_items, n_terms), np.int64)
    np.add.at(asked, (item, code), weight)
    scores = asked @ dense.T
    got = {(r["item"], r["doc_id"], r["score"]) for r in walk.result().to_pylist()}
    want = {(i, int(d), int(scores[i, d])) for i in range(n_items) for d in np.lexsort((np.arange(n_docs), -scores[i]))[:5]}
    assert got == want
    assert walk.scored < 0.15 * n_docs * n_items


def test_large_numbers_stay_exact():
    counts = object.__new__(lexical_search.Counts)
    counts.docs, counts.terms = 10 ** 12, 10 ** 15
    n, tf = np.array([10 ** 7, 3]), np.array([10 ** 6, 1])
    want = [1000000000 * f // (1000 * f + 12 * (75 + 25 * k * 10 ** 12 // 10 ** 15)) for k, f in zip(n.tolist(), tf.tolist())]
    assert counts.parts(n, tf).tolist() == want
    tree = lexical_search.ItemTree(np.array([0, 1]), np.array([0, 0]), np.array([10 ** 12, 3]))
    walk = lexical_search.Walk(tree, np.zeros(2, np.int64), 1)
    walk.add(np.array([4, 9]), np.zeros(2, bool), np.array([0, 1]), np.array([0, 0]), np.array([999_983, 999_984]))
    assert {tuple(r.values()) for r in walk.result().to_pylist()} == {(0, 9, 999_984 * 10 ** 12), (1, 9, 3 * 999_984)}


# --- language ---------------------------------------------------------------

def test_held_out_accuracy(spark):
    table = common.read(spark, MID_SF, "documents")
    rows = language_id.op11_language_id(spark, MID_SF).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == table.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_prediction_sees_text_only_and_covers_every_row(spark, docs, empty):
    table = common.read(spark, SMALL_SF, "documents")
    model = language_id.train(table)
    got = _plain(language_id.predict(docs, model).collect())
    other = docs.select((F.col("doc_id") * 0 + 5).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"))
    assert sorted(r[1:] for r in got) == sorted(tuple(r)[1:] for r in language_id.predict(other, model).collect())
    assert sorted(repr(r[0]) for r in got) == sorted(repr(r[0]) for r in _rows())
    letters = [any(c.isalpha() for c in t or "") for _, t, *_ in _rows()]
    assert sum(r[1] == "und" and r[2] == 0 for r in got) == letters.count(False) > 3
    assert {r[1] for r in got} <= {*model.labels, "und"}
    assert language_id.predict(empty, model).count() == 0
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, None).collect()} == {("und", 0.0)}


def test_learns_from_labelled_rows_outside_the_held_out_fifth_only(spark, empty):
    assert language_id.train(empty) is None
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    held = [i for i in range(400) if not zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "aba abab abba", "a") for i in free[:40]] + [(i, "xyx yxyy xxy", "b") for i in free[40:80]]
    rows += [(i, "mnm nmn", "only held out") for i in held] + [(i, "mnm nmn", None) for i in free[80:]] + [(None, "mnm", "null id"), (free[0], None, "no text"), (free[1], "12", "no letter")]
    df = common.cut(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2), "test-lang")
    model = language_id.train(df)
    assert model.labels == ["a", "b"]
    again = language_id.train(df.repartition(3))
    assert all((x == y).all() for x, y in zip(model.parameters(), again.parameters()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert all(got[i][0] == "a" and got[i][1] > 0.5 for i in free[2:40]) and all(got[i][0] == "b" for i in free[40:80])


def test_more_labels_than_the_bound_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LABELS", 3)
    df = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(60)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(df)


def test_network_equals_plain_loops():
    rng = np.random.default_rng(2)
    model = language_id.Model.fresh(["p", "q", "r"], rng)
    model.bias[:] = rng.normal(0, 1, len(model.bias))
    data = rng.integers(0, 256, 700).astype(np.uint8)
    row, first, end = language_id.starts(np.array([0, 0, 300, 301, 700]))
    assert row.tolist() == [1, 1, 2, 3, 3] and first.tolist() == [0, 256, 300, 301, 557]
    w = language_id.windows(data, first, end)
    wide = [k for k in language_id.WIDTHS for _ in range(language_id.FILTERS)]
    for x, got in zip(w, model.log_probabilities(w)):
        pooled = [max(sum(float(model.tables[j][x[p + j], f]) for j in range(k)) for p in range(language_id.WINDOW)) for f, k in enumerate(wide)]
        h = np.maximum(np.array(pooled) + model.bias, 0)
        z = h @ model.weight + model.shift
        assert np.allclose(got, z - np.log(np.exp(z - z.max()).sum()) - z.max(), atol=1e-3)
    for x, a, b in zip(w, first, end):
        assert x[:b - a].tolist() == data[a:min(b, a + w.shape[1])].tolist() and not x[b - a:].any()


def test_gradients_equal_differences():
    rng = np.random.default_rng(6)
    model = language_id.Model.fresh(["p", "q"], rng)
    for p in model.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    w, y = rng.integers(97, 123, (8, language_id.WINDOW + 3)).astype(np.uint8), rng.integers(0, 2, 8)
    loss = lambda: -model.log_probabilities(w)[np.arange(8), y].mean()
    for p, g in zip(model.parameters(), model.gradients(w, y)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[at], np.float32(2e-3)
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


@pytest.mark.parametrize("name", ["op12_fill_middle", "op13_lexical_search"])
def test_queries_equal_sql(spark, name):
    from shelfwise.llm import queries
    from tests.compare import compare, duck_connection

    ok, said = compare(queries.QUERIES[name](spark, SMALL_SF), duck_connection(SMALL_SF), queries.ORACLE_SQL[name])
    assert ok, said
