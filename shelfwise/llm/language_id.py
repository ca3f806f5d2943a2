"""Language identification by a small convolutional network over bytes.

A text is lower-cased, everything but letters a-z and bytes over 0x7F becomes a
blank, and runs of blanks become one. The bytes are cut into windows of fixed
length. Filters of several widths read the bytes of a window (a filter holds a
number for every byte value at each of its places, that is a convolution over
one-hot bytes); the largest answer of each filter over the window goes through
a rectifier and a softmax layer. A document is scored by all its windows: the
mean of their log-probabilities, weighted by their bytes.

The network is trained in numpy on the driver (Adam, fixed seed and number of
passes) on windows of a bounded sample: about ``SAMPLE`` labelled documents for
each language, picked by a hash bound that follows from the language's row
count, and ``SPREAD`` windows spread evenly over each of them. Only text and
label of rows outside the held-out fifth are learned; the prediction sees text
only. Every window of every document is predicted, on the executors, from the
broadcast weights (about 150 KB).

Defined results: ``und`` with score 0 for a null text, a text without a letter
(Unicode category L), or when there is nothing to learn from. A null doc_id
counts as held out. Repeated rows stay rows. Equal probabilities go to the
smaller label by code point. Very long texts are scored whole, window by window.
An empty table gives an empty table. Labels are the classes of the softmax; more
than ``MOST_LABELS`` of them are an error, not cut. Other columns, also ones
named like a result, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import common

WINDOW = 256
# Filter widths, largest first, and filters of each width.
WIDTHS, FILTERS = (4, 3, 2), 16
SAMPLE, SPREAD, MOST_LABELS = 600, 4, 1000
PASSES, BATCH, RATE, SEED = 8, 64, 3e-3, 11
FOLDS = 5
NONE = "und"
SCHEMA = "doc_id bigint, lang_pred string, score double"

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


# --- text to windows --------------------------------------------------------

def letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts after normalisation, row offsets into them)."""
    text = pc.utf8_lower(pc.fill_null(text, "").cast(pa.large_string()))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = _LETTERS[np.frombuffer(text.buffers()[2] or b"", np.uint8)[int(offsets[0]):int(offsets[-1])]]
    offsets = offsets - offsets[0]
    blank = data == 0x20
    before = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = ~(blank & before)
    return data[keep], np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[offsets]


def windows(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes from each ``first`` on, 0 beyond ``end``; a window sees the bytes
    after it that its last filters reach."""
    at = first[:, None] + np.arange(WINDOW + WIDTHS[0] - 1)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, end of row) of every window."""
    count = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    return row, offsets[row] + WINDOW * common.ranges(np.zeros(len(count), np.int64), count), offsets[row + 1]


# --- network ----------------------------------------------------------------

@dataclass
class Model:
    """``tables[j]`` holds, for every byte value, what it adds at place j to the
    filters that are wider than j (filters in the order of ``WIDTHS``)."""

    labels: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Model:
        n = FILTERS * len(WIDTHS)
        wide = [FILTERS * sum(w > j for w in WIDTHS) for j in range(WIDTHS[0])]
        return cls(labels, [rng.normal(0, 0.3, (256, k)).astype(np.float32) for k in wide], np.zeros(n, np.float32),
                   rng.normal(0, 0.2, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.weight, self.shift]

    def answers(self, w: np.ndarray) -> np.ndarray:
        """Filter answers (window, position, filter) before pooling."""
        acc = self.tables[0][w[:, :WINDOW]]
        for j, table in enumerate(self.tables[1:], 1):
            acc[:, :, :table.shape[1]] += table[w[:, j:WINDOW + j]]
        return acc

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectified features, log-probabilities) of pooled answers."""
        h = np.maximum(pooled + self.bias, 0)
        z = (h @ self.weight + self.shift).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return h, z - np.log(np.exp(z).sum(1, keepdims=True))

    def log_probabilities(self, w: np.ndarray) -> np.ndarray:
        out = [self.head(self.answers(w[i:i + BATCH]).max(1))[1] for i in range(0, len(w), BATCH)]
        return np.concatenate(out) if out else np.empty((0, len(self.labels)))

    def gradients(self, w: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        acc = self.answers(w)
        place = acc.argmax(1)
        pooled = np.take_along_axis(acc, place[:, None], 1)[:, 0]
        h, logp = self.head(pooled)
        dz = (np.exp(logp) - np.eye(len(self.labels))[y]).astype(np.float32) / len(w)
        dh = (dz @ self.weight.T) * (h > 0)
        rows = np.arange(len(w))[:, None]
        grads = []
        for j, table in enumerate(self.tables):
            g, k = np.zeros_like(table), table.shape[1]
            np.add.at(g, (w[rows, place[:, :k] + j], np.arange(k)), dh[:, :k])
            grads.append(g)
        return [*grads, dh.sum(0), h.T @ dz, dz.sum(0)]


def fit(w: np.ndarray, y: np.ndarray, labels: list[str]) -> Model:
    """Adam over the windows ``w`` with class numbers ``y``; the same rows give the same model."""
    rng = np.random.default_rng(SEED)
    model = Model.fresh(labels, rng)
    params = model.parameters()
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(PASSES):
        order = rng.permutation(len(w))
        for i in range(0, len(order), BATCH):
            step += 1
            at = order[i:i + BATCH]
            for p, g, m, s in zip(params, model.gradients(w[at], y[at]), mean, square):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (RATE * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return model


# --- Spark ------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            data, offsets = letters(part.column("text"))
            row, first, end = starts(offsets)
            count = np.bincount(row, minlength=part.num_rows)
            base, held = np.cumsum(count) - count, np.minimum(count, SPREAD)
            k = common.ranges(np.zeros(len(held), np.int64), held)
            of = np.repeat(np.arange(len(held)), held)
            pick = base[of] + (2 * k + 1) * count[of] // (2 * held[of])
            w = windows(data, first[pick], end[pick]) if len(pick) else np.empty((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("lang").take(pa.array(of)), pa.array([x.tobytes() for x in w], pa.binary())], ["lang", "window"])


def train(docs: DataFrame, text: str = "text", label: str = "lang") -> Model | None:
    """The network learned from the labelled rows of ``docs`` outside the held-out fifth; None without such rows."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        "doc_id", F.col(text).alias("text"), F.col(label).alias("lang"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages: is {label!r} a label?")
    if not counts:
        return None
    labels = sorted(counts)
    bound = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, SAMPLE / counts[k]))])
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    held = rows.where(share < F.get(F.map_values(bound), F.array_position(F.map_keys(bound), F.col("lang")).cast("int") - 1))
    found = held.mapInArrow(_spread, "lang string, window binary").toArrow()
    pairs = sorted(zip(found.column("lang").to_pylist(), found.column("window").to_pylist()))
    w = np.frombuffer(b"".join(x for _, x in pairs), np.uint8).reshape(len(pairs), -1)
    y = np.array([labels.index(k) for k, _ in pairs], np.int64)
    return fit(w, y, labels)


def _predict(shared):
    def one(part: pa.RecordBatch, model: Model | None) -> pa.RecordBatch:
        text, n = part.column("text"), part.num_rows
        known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        if model is not None:
            data, offsets = letters(text)
            row, first, end = starts(offsets)
            total = np.zeros((n, len(model.labels)))
            for i in range(0, len(row), BATCH):
                s = slice(i, i + BATCH)
                size = np.minimum(end[s] - first[s], WINDOW)
                np.add.at(total, row[s], model.log_probabilities(windows(data, first[s], end[s])) * size[:, None])
            mean = total / np.maximum(np.diff(offsets), 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best, score = p.argmax(1), p.max(1)
        labels = pa.array([*(model.labels if model else []), NONE])
        found = np.where(known & (model is not None), best, len(labels) - 1)
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), labels.take(pa.array(found)), pa.array(np.where(found < len(labels) - 1, score, 0.0))],
            ["doc_id", "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in common.slices(batch):
                yield one(part, model)

    return run


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shared), SCHEMA)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return predict(docs, train(docs)).withColumn("held_out", held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score")
