"""Binary token files with Re-Pair grammar compression.

Documents in ascending id are dealt into ranges of about ``BUCKET_TOKENS`` ids, as
many as the table needs, and each range is cut into shards of about
``SHARD_TOKENS`` ids (one longer document is a shard of its own). A range may end
inside the rows of one id, or of the null ids. In a shard, frequent id pairs are
replaced by nonterminals, round by round with falling thresholds, until no
pair occurs ``LEAST`` times, where a rule costs as much as it saves; pairs never
cross a document. A file holds the
rules, the expansion length of every rule, the offset of every document and
the symbols that are left, 16 bits of each in a row and the higher bits as planes. ``read_document`` decodes one document alone;
``read_ids`` decodes part of it: expansion lengths say which symbol holds an
id. A table beside the files names them in order with their first id.

Files are written under the shared folder through Arrow file systems, under a
temporary name that is moved at the end; a repeated task writes the same file.

Null ids come first and stay null; rows with one id follow by length and
content. Null and empty texts hold the end id alone. An empty table gives no
file. Other columns of the input are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import bpe, common

END_ID = 1
SHARD_TOKENS = 1 << 20
BUCKET_TOKENS = 8 << 20
# Files that a task reads, one after the other: one alone takes less time than its task.
READ_FILES = 4
# A rule takes 12 bytes in a file and saves at least 2 at each place.
LEAST = 7
MAGIC = b"RPTOK002"


# -- grammar -----------------------------------------------------------------
def _candidates(seq: np.ndarray, at: np.ndarray | None, least: int) -> np.ndarray:
    """The places among ``at`` (None: all) whose pair may occur ``least`` times: pairs are
    counted by a hash first, so that few rare ones are left to count one by one."""
    left, right = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
    wide = 16 if least > 128 else 18
    slot = left * np.uint32(0x9E3779B1)
    slot += right * np.uint32(0x85EBCA77)
    slot >>= np.uint32(32 - wide)
    slot = slot.astype(np.int64)
    often = (np.bincount(slot, minlength=1 << wide) >= least)[slot]
    return np.flatnonzero(often) if at is None else at[often]


def compress(ids: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, document ends in symbols, rules as rows (left, right)).
    ``first`` is the number of the first rule; ids are below it."""
    seq, rules, nxt = ids.astype(np.uint32), [], first
    filled = np.diff(ends, prepend=0) > 0
    last = ends[filled] - 1  # the last symbol of each document with ids
    least, near = max(LEAST, len(seq) // 2048), None
    while len(seq) > 1:
        at = _candidates(seq, near, least)
        stop = np.searchsorted(at, last)
        stop, end = stop[stop < len(at)], last[stop < len(at)]
        at = np.delete(at, stop[at[stop] == end])
        key = seq[at].astype(np.uint64)
        key <<= np.uint64(32)
        key |= seq[at + 1]
        coded = pa.array(key).dictionary_encode()
        pairs, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        good = np.bincount(back, minlength=len(pairs)) >= least
        if least == LEAST and not good.any():
            break
        if good.any():
            number = np.zeros(len(pairs), np.uint32)  # 0: no rule
            number[good] = np.arange(nxt, nxt + int(good.sum()))
            new = number[back]
            hit = np.flatnonzero(new)
            at, new = at[hit], new[hit]
            # Overlapping matches: within a run of neighbours every other one, from the left.
            run = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            place = np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))
            take = np.flatnonzero(place % 2 == 0)
            at, new = at[take], new[take]
            rules.append(np.stack([(pairs[good] >> np.uint64(32)).astype(np.int64),
                                   (pairs[good] & np.uint64(0xFFFFFFFF)).astype(np.int64)], 1))
            nxt += int(good.sum())
            seq[at] = new
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq, last = seq[stay], last - np.searchsorted(at, last)
            at -= np.arange(len(at))
        # After a round at the last threshold only pairs with a new symbol can reach it.
        if least == LEAST:
            touched = np.zeros(len(seq) + 1, bool)  # the spare place stands for the one before the first symbol
            touched[at] = touched[at - 1] = True
            near = np.flatnonzero(touched[:len(seq) - 1])
        least = max(LEAST, least // 8)
    sym_ends = np.zeros(len(ends), np.int64)
    sym_ends[filled] = last + 1
    return seq.astype(np.int64), np.maximum.accumulate(sym_ends), np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Expansion length of every rule; a rule names only ids and earlier rules."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.asarray(out, np.int64)


def expand(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Replace rules level by level until only ids are left."""
    while len(rules):
        at = np.flatnonzero(seq >= first)
        if not len(at):
            break
        pair = rules[seq[at] - first]
        seq = np.insert(seq, at + 1, pair[:, 1])
        seq[at + np.arange(len(at))] = pair[:, 0]
    return seq


# -- file format -----------------------------------------------------------------
def bits(symbols: int) -> int:
    """Bits of a symbol, 16 at least."""
    return max(16, (symbols - 1).bit_length())


def split(seq: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The low 16 bits of each symbol, and every higher bit as a plane of one bit a symbol."""
    planes = [np.packbits((seq >> k & 1).astype(bool)) for k in range(16, bits(symbols))]
    return seq & 0xFFFF, np.concatenate([np.empty(0, np.uint8), *planes])


def dump(doc_ids: list, ends: np.ndarray, ids: np.ndarray) -> bytes:
    first = max(int(ids.max()) + 1 if len(ids) else 0, END_ID + 1)
    seq, sym_ends, rules = compress(ids, ends, first)
    low, high = split(seq, first + len(rules))
    null = np.asarray([d is None for d in doc_ids], np.uint8)
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<QQQQ", first, len(rules), len(doc_ids), len(seq)))
    for a, kind in ((rules, "<u4"), (lengths(rules, first), "<u4"), (null, "u1"),
                    (np.asarray([d or 0 for d in doc_ids], np.int64), "<i8"), (ends, "<u8"), (sym_ends, "<u8"), (low, "<u2"), (high, "u1")):
        out.write(a.astype(kind).tobytes())
    return out.getvalue()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.first, n_rules, n_docs, n_seq = struct.unpack_from("<QQQQ", data, 8)
        at = 8 + struct.calcsize("<QQQQ")

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(data, kind, n, at)
            at += a.nbytes
            return a.astype(np.int64)

        self.rules = take(2 * n_rules, "<u4").reshape(-1, 2)
        self.rule_lengths = take(n_rules, "<u4")
        null, ids = take(n_docs, "u1"), take(n_docs, "<i8")
        self.doc_ids = [None if z else i for z, i in zip(null.tolist(), ids.tolist())]
        self.ends = take(n_docs, "<u8")
        self.sym_ends = take(n_docs, "<u8")
        self.seq = take(n_seq, "<u2")
        for k in range(16, bits(self.first + n_rules)):
            plane = np.frombuffer(data, "u1", -(-n_seq // 8), at)
            at += plane.nbytes
            self.seq |= np.unpackbits(plane, count=n_seq).astype(np.int64) << k

    def __len__(self) -> int:
        return len(self.doc_ids)

    def read_document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.sym_ends[i - 1] if i else 0:self.sym_ends[i]], self.rules, self.first)

    def read_ids(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop) of document i; only the symbols that hold them are expanded."""
        seq = self.seq[self.sym_ends[i - 1] if i else 0:self.sym_ends[i]]
        big = seq >= self.first
        size = np.where(big, self.rule_lengths[np.where(big, seq - self.first, 0)], 1) if len(self.rules) else np.ones(len(seq), np.int64)
        upto = np.cumsum(size)
        a, b = np.searchsorted(upto, start, "right"), np.searchsorted(upto, stop, "left")
        skip = start - (upto[a - 1] if a else 0)
        return expand(seq[a:b + 1], self.rules, self.first)[skip:skip + stop - start]

    def read_all(self) -> np.ndarray:
        """Every rule is spelled out once and copied to its places; where the rules are
        longer than the documents, the symbols are expanded instead."""
        spelled = int(self.rule_lengths.sum())
        if not spelled or spelled > self.ends[-1]:
            return expand(self.seq, self.rules, self.first)
        rules = np.arange(self.first, self.first + len(self.rules), dtype=np.uint32)
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), expand(rules, self.rules.astype(np.uint32), self.first)])
        ends = np.concatenate([np.arange(self.first + 1), self.first + np.cumsum(self.rule_lengths)])
        spellings = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat))
        return spellings.take(pa.array(self.seq)).values.to_numpy()


def store(uri: str):
    """Arrow file system and path of a folder named by path or URI."""
    import pyarrow.fs as pafs

    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def put(uri: str, name: str, data: bytes) -> None:
    fs, path = store(uri)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def get(uri: str, name: str) -> bytes:
    fs, path = store(uri)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        return f.read()


# -- writing and reading on Spark --------------------------------------------------
PACKED = "doc_id bigint, n bigint, packed binary"


def _packed(doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Ids with the end id, packed where they are made: neither the JVM nor a second
    Python worker of the task holds them, and the shuffle carries few bytes."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1)
    wide = len(ids) > 0 and int(ids.max()) >= 65536
    packed, ids = [], np.insert(ids.astype("<u4" if wide else "<u2"), ends[1:], END_ID)  # an end id goes before what stands at ``ends``
    ends = ends + np.arange(len(ends))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        row = ids[a:b]
        if wide and row.max() < 65536:
            row = row.astype("<u2")
        packed.append(bytes([row.itemsize]) + zip_.compress(row))
    return pa.table({"doc_id": doc_ids, "n": pa.array(np.diff(ends), pa.int64()), "packed": pa.array(packed, pa.binary())})


@lru_cache(maxsize=1)
def _unzip():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(_unzip()(b[1:]), "<u2" if b[0] == 2 else "<u4")


def _writer(folder: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, number, n = TaskContext.get().partitionId(), 0, 0

        def flush():
            rows = [unpack(p) for _, p in held]
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
            name = f"tokens-{bucket:08d}-{number:08d}.rp"
            put(folder, name, dump([d for d, _ in held], ends, ids))
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()),
                 pa.array([len(held)], pa.int64())], ["bucket", "number", "name", "n_tokens", "n_docs"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and n + row["n"] > shard_tokens:
                    yield flush()
                    number, held, n = number + 1, [], 0
                held.append((row["doc_id"], row["packed"]))
                n += row["n"]
        if held:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, vocabulary: bpe.Vocabulary | None = None,
          shard_tokens: int = SHARD_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Write the files; returns their table: bucket, number, name, start, n_tokens, n_docs."""
    with common.scratch(docs.sparkSession):
        with common.scratch(docs.sparkSession):  # blocks and words go before the files are written
            # Stored, as the range bounds are sampled from it before it is dealt.
            packed = common.cut(bpe.encode(docs, vocabulary, _packed, PACKED), "token-rows", keep=True)
        buckets = max(1, -(-(packed.agg(F.sum("n")).first()[0] or 0) // bucket_tokens))
        order = [F.col("doc_id").asc_nulls_first(), "n", "packed"]
        ordered = packed.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
        files = common.cut(ordered.mapInArrow(
            _writer(folder, shard_tokens), "bucket int, number int, name string, n_tokens bigint, n_docs bigint"), "token-files")
        before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        total = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n_tokens"))  # one row per range
        total = common.cut(total.select("bucket", before(W.orderBy("bucket")).alias("base")), "token-ranges")
        return common.cut(files.join(common.broadcast_if_small(total, 24), "bucket").select(
            "bucket", "number", "name", (F.col("base") + before(W.partitionBy("bucket").orderBy("number"))).alias("start"),
            "n_tokens", "n_docs"), "token-index", keep=True)


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(get(folder, row["name"]))
                ids = f.read_all().astype("<u4", copy=False)
                if len(ids) != row["n_tokens"]:
                    raise RuntimeError(f"{row['name']} holds {len(ids)} ids, its index says {row['n_tokens']}")
                starts = np.concatenate([[0], f.ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f.doc_ids, pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(f.ends - starts, pa.int64()),
                     pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, f.ends)], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_back(index: DataFrame, folder: str) -> DataFrame:
    tasks = max(1, -(-index.count() // READ_FILES))
    return index.select("name", "start", "n_tokens").repartition(tasks, "name").mapInArrow(
        _reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.work_folder(spark, "tokens")
    return read_back(write(common.read(spark, sf_dir, "documents"), folder), folder)
