"""Shared anchors: where a document may repeat a window of fixed length.

The smallest of the gram hashes in a window is its anchor; equal windows have
equal anchors at the same place, so a window whose anchor no other place has
cannot repeat. A task cuts documents into blocks, keeps the anchors of a block
(about two in ``window - gram + 2`` positions), packs them by hash range and
writes them once; ranges of all blocks meet in one small group each, which
answers with the positions of shared anchors. False hits (equal hashes) only
cost work, no repeat is lost. Hot anchors come once per position and block
and are never paired with each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common

BLOCK_BYTES = 512 << 10  # temporary arrays then stay in cache
RANGE_BYTES = 8 << 20  # text bytes per hash range
LAST_ID = 2 ** 63 - 1  # order of null ids


# -- units -----------------------------------------------------------------------
_BYTE = common.mix(np.arange(1, 257, dtype=np.uint64))
_P = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets."""
    flat = pc.fill_null(text, "").cast(pa.large_string()).cast(pa.large_binary())
    flat = pa.concat_arrays([flat])  # own buffers, no slice offset
    ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1)
    data = np.frombuffer(flat.buffers()[2], np.uint8, int(ends[-1])) if flat.buffers()[2] else np.empty(0, np.uint8)
    return data[ends[0]:], ends - ends[0]


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes at each position (k a power of two)."""
    h, span, power = _BYTE[data], 1, _P
    while span < k:
        if len(h) <= span:
            return np.empty(0, np.uint64)
        h = h[:-span] * power + h[span:]
        power = np.uint64(int(power) * int(power) % 2 ** 64)
        span *= 2
    return common.mix(h)


def byte_units(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(text)
    return byte_grams(data, k), offsets


def word_units(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = common.flat_words(text)
    return common.gram_hashes(common.word_hashes(flat), k), offsets


Units = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]


def window_anchors(grams: np.ndarray, offsets: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows inside rows, position of the anchor of each)."""
    w = window - k + 1
    if len(grams) < w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Ties of the upper hash half go to the left, in every row alike.
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[:len(least) - (w - span)], least[w - span:])
    starts = common.ranges(offsets[:-1], np.maximum(np.diff(offsets) - window + 1, 0))
    return starts, (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)


# -- shared anchors ----------------------------------------------------------------
def _planes(a: np.ndarray) -> bytes:
    """Zstandard over byte planes: leading zero bytes vanish."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unplanes(b: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


_BLOCKS = pa.schema([("block", pa.binary()), ("part", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()),
                     ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])


def anchor_marks(units: Units, k: int, window: int):
    """Marks of the first round: (hashes, places) of all anchors, one place per unit."""
    def run(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, offsets = units(part.column("text"), k)
        _, at = window_anchors(grams, offsets, k, window)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        return grams[at], at, offsets

    return run


def context_marks(k: int):
    """Marks of the second round, over bytes: a shared anchor with the k bytes
    before it (even places) and with the k bytes after it (odd places). A
    window of 3 k + 2 bytes that holds the anchor holds one of the two."""
    def run(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = text_bytes(part.column("text"))
        grams = byte_grams(data, 2 * k)
        places = [np.frombuffer(b, "<u4").astype(np.int64) + o for b, o in zip(part.column("places").to_pylist(), offsets[:-1])]
        at = np.concatenate(places) if places else np.empty(0, np.int64)
        row = np.searchsorted(offsets, at, "right") - 1
        left, right = at - k >= offsets[row], at + 2 * k <= offsets[row + 1]
        gram = np.concatenate([grams[at[left] - k], grams[at[right]]])
        place = np.concatenate([at[left] * 2, at[right] * 2 + 1])
        order = np.argsort(place, kind="stable")
        return gram[order], place[order], offsets * 2

    return run


def _pack(marks, parts: int, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=BLOCK_BYTES):
                h, at, offsets = marks(part)
                h = h >> np.uint64(16)
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                doc = at if within else np.searchsorted(offsets, at, "right")
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
                first = np.flatnonzero(new)
                twice = np.zeros(len(h), bool)
                if len(h):  # more than one document (or place) of this block has the anchor
                    differ = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                    twice = np.repeat(differ, np.diff(np.append(first, len(h))))
                bucket = ((h >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                edges = np.searchsorted(bucket, np.arange(parts + 1))
                used = np.flatnonzero(np.diff(edges))
                block = uuid.uuid4().bytes
                rows = {f.name: [] for f in _BLOCKS}
                for b in used.tolist():
                    s = slice(edges[b], edges[b + 1])
                    rows["block"].append(block)
                    rows["part"].append(b)
                    rows["hashes"].append(_planes(np.diff(h[s], prepend=np.uint64(0))))
                    rows["places"].append(_planes(at[s].astype(np.uint64) * np.uint64(2) + twice[s]))
                    for c in ("doc_ids", "keys", "offsets"):
                        rows[c].append(None)
                rows["block"].append(block)
                rows["part"].append(-1)
                rows["hashes"].append(None)
                rows["places"].append(None)
                rows["doc_ids"].append(part.column("ord").to_pylist())
                rows["keys"].append(part.column("key").to_pylist())
                rows["offsets"].append(offsets.tolist())
                yield pa.RecordBatch.from_pydict(rows, schema=_BLOCKS)

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Shared anchors of one hash range: positions for each block."""
    hashes = [np.cumsum(_unplanes(b)) for b in group.column("hashes").to_pylist()]
    places = [_unplanes(b) for b in group.column("places").to_pylist()]
    blocks = group.column("block").to_pylist()
    source = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(h) for h in hashes])
    h, place = np.concatenate(hashes), np.concatenate(places)
    del hashes, places
    order = np.argsort(h, kind="stable")  # keeps the rows of one block together
    first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    s = source[order]
    shared = (np.minimum.reduceat(s, first) != np.maximum.reduceat(s, first)) | (
        np.maximum.reduceat(place[order] & np.uint64(1), first) > 0)
    keep = np.zeros(len(h), bool)
    keep[order] = np.repeat(shared, np.diff(np.append(first, len(h))))
    s, at = source[keep], (place[keep] >> np.uint64(1)).astype("<u4")
    edges = np.searchsorted(s, np.arange(len(blocks) + 1))
    found = [i for i in range(len(blocks)) if edges[i + 1] > edges[i]]
    return pa.table({"block": pa.array([blocks[i] for i in found], pa.binary()),
                     "at": pa.array([at[edges[i]:edges[i + 1]].tobytes() for i in found], pa.binary())})


def _give_back(documents: pa.Table, shared: pa.Table) -> pa.Table:
    """Positions of shared anchors in each document of a block."""
    out: dict[str, list] = {"ord": [], "key": [], "places": []}
    at = np.sort(np.frombuffer(b"".join(shared.column("at").to_pylist()), "<u4").astype(np.int64))
    for row in documents.to_pylist() if len(at) else []:
        offsets = np.asarray(row["offsets"], np.int64)
        edges = np.searchsorted(at, offsets)
        for i in np.flatnonzero(np.diff(edges)).tolist():
            out["ord"].append(row["doc_ids"][i])
            out["key"].append(row["keys"][i])
            out["places"].append((at[edges[i]:edges[i + 1]] - offsets[i]).astype("<u4").tobytes())
    return pa.table({"ord": pa.array(out["ord"], pa.int64()), "key": pa.array(out["key"], pa.int64()), "places": pa.array(out["places"], pa.binary())})


def keyed(docs: DataFrame) -> DataFrame:
    """ord (id, null ids last), key (tells texts of one id apart), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord"), F.xxhash64(text).alias("key"), text.alias("text"))


def copies(docs: DataFrame) -> DataFrame:
    """(ord, key) of the documents whose whole text a smaller id has."""
    names = keyed(docs).select("ord", "key", F.unhex(F.sha2("text", 256)).alias("sha"))
    names = common.cut(names, "text-names")
    first = names.groupBy("sha").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    # One row per text that has copies; joined by broadcast while small, so that no group of copies meets in a task.
    first = common.broadcast_if_small(common.cut(first.select("sha", "first"), "text-firsts"), 64)
    return common.cut(names.join(first, "sha").where("ord > first").select("ord", "key").distinct(), "text-copies")


def affected(texts: DataFrame, marks, within: bool, size: int | None = None) -> DataFrame:
    """(ord, key, places): documents with shared marks, and where they are
    (little-endian u4). ``within``: a second place in the same document counts."""
    if size is None:
        size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()[0] or 0
    parts = int(max(8, -(-size // RANGE_BYTES)))
    packed = common.cut(texts.mapInArrow(
        _pack(marks, parts, within),
        "block binary, part int, hashes binary, places binary, doc_ids array<bigint>, keys array<bigint>, offsets array<bigint>"), "anchors")
    met = packed.where("part >= 0").select("block", "part", "hashes", "places").groupBy("part").applyInArrow(_meet, "block binary, at binary")
    met = common.cut(met, "shared-anchors")
    blocks = packed.where("part < 0").select("block", "doc_ids", "keys", "offsets")
    return common.cut(blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        _give_back, "ord bigint, key bigint, places binary"), "affected")


def bytes_per_row(info: DataFrame, column: str) -> tuple[int, int]:
    """(mean bytes of a row, bytes of the column in all)."""
    size = info.agg(F.sum(F.octet_length(column)).alias("b"), F.count("*").alias("n")).first()
    return 32 + (size["b"] or 0) // max(1, size["n"]), size["b"] or 0


def with_info(texts: DataFrame, info: DataFrame, row_bytes: int, how: str = "inner") -> DataFrame:
    """Join small facts to texts; texts are shuffled only if the facts are too large to broadcast."""
    return texts.join(common.broadcast_if_small(info, row_bytes), ["ord", "key"], how)


def shared_windows(part: pa.RecordBatch, units: Units, k: int, window: int, sides: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, offsets) of the windows of a slice whose anchor is
    shared; with two sides, whose anchor is shared with the context it has."""
    grams, offsets = units(part.column("text"), k)
    starts, at = window_anchors(grams, offsets, k, window)
    places = [np.frombuffer(b, "<u4").astype(np.int64) + o * sides for b, o in zip(part.column("places").to_pylist(), offsets[:-1])]
    shared = np.zeros(int(offsets[-1]) * sides + 2, bool)
    shared[np.concatenate(places) if places else np.empty(0, np.int64)] = True
    need = at if sides == 1 else at * 2 + (at - starts < k)
    keep = shared[need] if len(at) else np.empty(0, bool)
    return starts[keep], at[keep], offsets


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Units of a row of n that windows at ``starts`` cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + window, n), -1)
    return np.cumsum(delta[:-1]) > 0
