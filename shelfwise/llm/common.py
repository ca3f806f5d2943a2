"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir, subdir

# Fixed value: the white space of every word contract (space and 0x09-0x0D).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Text handled at once inside a Python task; one longer document is its own slice.
SLICE_BYTES = 4 << 20
# Largest frame that is ever hinted for broadcast, after its size was measured.
BROADCAST_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package, wherever
    the driver was started (a cluster installs it under the same path)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one table under the shared folder of the cluster."""
    base = checkpoint_dir(spark, local_fallback=True)
    return subdir(subdir(base, "llm"), f"{name}-{uuid.uuid4().hex}")


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column but the used ones renamed by its position, so
    that no user column can clash with one of ours, and the new names in order.
    ``select(*names).toDF(*docs.columns)`` brings the old names back."""
    names = [c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


_SCRATCH: list[list[str]] = []
# Spark drops the shuffle files of a statement when it ends (they would live as long as the session's driver otherwise).
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and the table survives the loss of any executor. The shuffle files of the
    statement go when it ends, as nothing reads them again. Inside ``scratch``
    the table lives until the end of the block; with ``keep``, of the block around it."""
    path = _write(df, name)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> str:
    spark = df.sparkSession
    path = work_folder(spark, name)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return path


@contextmanager
def two_tables(df: DataFrame, name: str, kind: str):
    """Write ``df`` once and read it as two tables, the rows with ``kind`` "brief" and
    "lasting". The brief ones are deleted at the end of the block, the others with
    the ``scratch`` block around it, if there is one."""
    path = _write(df, name, (kind,))
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    spark = df.sparkSession
    stored = spark.read.schema(df.schema).parquet(path)
    try:
        yield tuple(stored.where(F.col(kind) == k).drop(kind) for k in ("brief", "lasting"))  # each reads its own folder
    finally:
        _delete(spark, subdir(path, f"{kind}=brief"))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are ``cut`` inside the block are deleted at its end. What the
    block hands on must be cut with ``keep`` (or be read to its end)."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in paths:
            _delete(spark, path)


def one_by_one(files: DataFrame, key: str, most: int = 20_000) -> DataFrame:
    """Deal a small table of file names over about as many tasks as files:
    their number is given, so that adaptive execution doesn't join the tasks."""
    return files.repartition(max(1, min(files.count(), most)), key)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast only if the written frame was counted and is small;
    otherwise the join stays a shuffle join (same rows either way)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def words_of(text: Column) -> Column:
    """Words of the contract as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into row ranges of about ``limit`` bytes of ``column``."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def flat_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column in one array, and the row offsets into it."""
    # ascii_split_whitespace splits at space and 0x09-0x0D, which is the contract.
    parts = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "")
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), kept[offsets]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (unsigned arithmetic wraps by intent)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word of the array is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_pylist()),
                        dtype=np.uint64, count=len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(words) else table


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (len - k + 1 values)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + word[i:i + n])
    return acc


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the integer ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
