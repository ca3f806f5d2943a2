"""Fill-in-the-middle transformation as a pyarrow.compute pipeline.

Spark draws four numbers of every document from the hash of its id. A task
takes its Arrow batch apart: the code points of the texts become one list array
(a list per segment of a text), which is flattened with parent indices; the
ordinal of a code point in its document and the two cuts of the document say
which of three roles it has; each role is filtered out, rebuilt into lists, and
joined by ``binary_join``, first per segment and then per document.

A segment is at most ``SEGMENT_BYTES`` of one document, and about
``GROUP_BYTES`` of segments are taken apart at once, so that the arrays of
single code points are bounded however long a text is. A text itself must fit
its task some times over (text, three pieces and output).

``restored`` gives the text back from output and form alone, as a Column: a text
that contains a marker stays plain, so a marker in an output is always ours.

Defined results: a null text counts as empty; an empty text is plain with n = 0.
A null id draws the numbers of the empty string; repeated rows stay rows, and
rows with the same id draw the same numbers. An empty table gives an empty
table. Other columns of the input, also ones named like a result, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import common

# Markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 1
# Per cent of documents that are transformed, and per cent of those in suffix-first order.
RATE, SPM_RATE = 90, 20
SEGMENT_BYTES = 1 << 18
GROUP_BYTES = 1 << 20
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _check(markers: tuple[str, str, str]) -> None:
    """An occurrence of a marker in an output must be a whole marker that we wrote."""
    for a in markers:
        for b in markers:
            if any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first byte) of every segment of the texts data[offsets[r]:offsets[r + 1]]."""
    count = -(-np.diff(offsets) // SEGMENT_BYTES)
    row = np.repeat(np.arange(len(count)), count)
    first = offsets[row] + common.ranges(np.zeros(len(count), np.int64), count) * SEGMENT_BYTES
    for _ in range(3):  # back to the first byte of a code point
        first = first - ((data[first] & 0xC0) == 0x80)
    return row, first


def code_points(data: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    """A list of single code points for each range between ``edges``."""
    base = int(edges[0])
    part = data[base:int(edges[-1])]
    starts = np.flatnonzero((part & 0xC0) != 0x80)
    ends = np.append(starts, len(part)).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(part))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, edges - base).astype(np.int32)), flat)


def pieces(text: pa.Array, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of every text, cut at code points ``low`` and ``high``."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[:int(offsets[-1])]
    row, first = segments(data, offsets)
    edges = np.append(first, offsets[-1])
    before = np.cumsum(length) - length
    found: list[list] = [[], [], []]
    at, seen = 0, 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + GROUP_BYTES, side="right")) - 1)
        units = code_points(data, edges[at:to + 1])
        parent, flat = pc.list_parent_indices(units), pc.list_flatten(units)
        of_row = pc.take(pa.array(row[at:to]), parent)
        ordinal = pc.subtract(pa.array(np.arange(seen, seen + len(flat))), pc.take(pa.array(before), of_row))
        seen += len(flat)
        in_prefix = pc.less(ordinal, pc.take(pa.array(low), of_row))
        in_suffix = pc.greater_equal(ordinal, pc.take(pa.array(high), of_row))
        in_middle = pc.invert(pc.or_(in_prefix, in_suffix))
        for out, role in zip(found, (in_prefix, in_middle, in_suffix)):
            kept = np.searchsorted(parent.filter(role).to_numpy(), np.arange(to - at + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(kept), flat.filter(role))
            out.append(pc.binary_join(lists, "").cast(pa.large_string()))
        at = to
    rows = pa.array(np.searchsorted(row, np.arange(len(length) + 1)))
    none = pa.array([], pa.large_string())
    sep = pa.scalar("", pa.large_string())
    return [pc.binary_join(pa.LargeListArray.from_arrays(rows, pa.concat_arrays([none, *out])), sep) for out in found]


def _transform(markers: tuple[str, str, str], rate: int, spm_rate: int):
    p, s, m = (pa.scalar(x, pa.large_string()) for x in markers)
    sep = pa.scalar("", pa.large_string())

    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        text = pc.fill_null(part.column("text"), "").cast(pa.large_string())
        n = pc.utf8_length(text)
        h1, h2, h3, h4 = (part.column(f"h{i}").to_numpy() for i in range(1, 5))
        length = n.to_numpy().astype(np.int64)
        x, y = h1 % (length + 1), h2 % (length + 1)
        plain = pc.equal(n, 0)
        for marker in markers:
            plain = pc.or_(plain, pc.match_substring(text, marker))
        plain = pc.or_(plain, pa.array(h3 % 100 >= rate))
        low, high = np.minimum(x, y), np.maximum(x, y)
        prefix, middle, suffix = pieces(text, low, high, length)
        spm = pa.array(h4 % 100 < spm_rate)
        psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, sep)
        spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, sep)
        output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text))
        form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
        none = pa.scalar(None, pa.int64())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(length), form, pc.if_else(plain, none, pa.array(low)),
             pc.if_else(plain, none, pa.array(high - low)), output.cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                yield one(part)

    return run


def transform(docs: DataFrame, markers: tuple[str, str, str] = MARKERS, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output of every row of ``docs``."""
    _check(markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    drawn = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)])
    return drawn.mapInArrow(_transform(markers, rate, spm_rate), SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of."""
    p, s, m = markers
    after = F.substring_index(output, m, -1)
    psm = F.concat(F.substr(F.substring_index(output, s, 1), F.lit(len(p) + 1)), after,
                   F.substring_index(F.substring_index(output, s, -1), m, 1))
    spm = F.concat(F.substring_index(F.substring_index(output, p, -1), m, 1), after,
                   F.substr(F.substring_index(output, p, 1), F.lit(len(s) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
