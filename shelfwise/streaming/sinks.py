"""Exactly-once folders behind ``foreachBatch``: closed rows and keyed snapshots.

A micro-batch that fails is run again under the same id with the same rows, so
a sink is exactly-once when writing a batch a second time changes nothing.
Both sinks get that by naming folders after the batch id and overwriting them.
Everything is written by the executors under the given (shared) folder; the
driver only lists, switches and drops folders.

``BatchFolders`` is for rows that are final when they come out (append mode): a
folder per batch, each row in exactly one of them, nothing to reduce on read.

``KeyedSnapshot`` is for rows that replace the earlier row of their key (update
mode). It holds

    snapshot/version=V   one row per key, the state after batch V
    deltas/batch=B       the rows that batch B changed, B > V
    switch/version=V     a one-row table, written when snapshot V is complete

A read takes the newest switched version and the deltas after it, so it reads
one snapshot and a bounded number of deltas however long the stream runs.
Every ``merge_every`` batches the two become the next version: the snapshot is
written first, then the switch, then versions and deltas that no longer serve
the last two versions are dropped. A run that dies before the switch leaves the
old version and all its deltas in force; one that dies after it leaves folders
which the next merge drops. The version before the newest is kept, so that a
read that has already listed its files can finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.session import subdir

BATCH = "_batch_id"
MERGE_EVERY = 10


def latest_per_key(changelog: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the greatest batch id of every key (a partial aggregation)."""
    values = [c for c in changelog.columns if c not in keys and c != BATCH]
    latest = changelog.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_s"))
    return latest.select(*keys, *[F.col("_s." + c).alias(c) for c in values])


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def _folder(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path): folders may be on any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers N of the folders ``name=N`` in ``path``."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.split("=", 1)[1]) for n in names if "=" in n)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


class BatchFolders:
    """Final rows, one folder per micro-batch. Empty until a batch is written."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder, _nullable(schema)
        # A first, empty batch: reading works before, and without, any row.
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(subdir(folder, "batch=-1"))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write the rows of a batch; writing it again changes nothing."""
        batch.select(*self.schema.names).write.mode("overwrite").parquet(subdir(self.folder, f"batch={batch_id}"))

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder).select(*self.schema.names)


class KeyedSnapshot:
    """The latest row of every key, as a snapshot plus the deltas since."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str], merge_every: int = MERGE_EVERY):
        if merge_every < 1:
            raise ValueError("merge_every must be at least 1")
        self.spark, self.folder, self.keys, self.merge_every = spark, folder, list(keys), merge_every
        self.schema = _nullable(schema)
        self.delta = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        if not _numbers(spark, subdir(folder, "switch")):
            spark.createDataFrame([], self.delta).write.mode("overwrite").parquet(self._path("snapshot", -1))
            self._switch(-1)

    def _path(self, kind: str, n: int) -> str:
        return subdir(subdir(self.folder, kind), f"{'batch' if kind == 'deltas' else 'version'}={n}")

    def versions(self) -> list[int]:
        """Versions in force, oldest first: those whose switch was committed."""
        out = []
        for v in _numbers(self.spark, subdir(self.folder, "switch")):
            fs, p = _folder(self.spark, subdir(self._path("switch", v), "_SUCCESS"))
            if fs.exists(p):
                out.append(v)
        return out

    def _switch(self, version: int) -> None:
        one = self.spark.createDataFrame([(version,)], "version bigint").coalesce(1)
        one.write.mode("overwrite").parquet(self._path("switch", version))

    def _rows(self, where: Column | None, upto: int | None = None) -> DataFrame:
        version = self.versions()[-1]
        batches = [b for b in _numbers(self.spark, subdir(self.folder, "deltas")) if b > version and (upto is None or b <= upto)]
        paths = [self._path("snapshot", version), *[self._path("deltas", b) for b in batches]]
        rows = self.spark.read.schema(self.delta).parquet(*paths)
        return rows if where is None else rows.where(where)

    def read(self, where: Column | None = None) -> DataFrame:
        """The latest row per key. ``where`` is a condition on the keys; it
        reaches the scans of the snapshot and of the deltas."""
        return latest_per_key(self._rows(where), self.keys).select(*self.schema.names)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take in the changed rows of a micro-batch. A batch that a version
        already holds is left alone, any other is written over."""
        version = self.versions()[-1]
        if batch_id <= version:
            return
        rows = batch.select(*self.schema.names).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").parquet(self._path("deltas", batch_id))
        if batch_id - version >= self.merge_every:
            self.merge(batch_id)

    def merge(self, upto: int) -> None:
        """Make the state after batch ``upto`` the version that reads start from."""
        rows = self._rows(None, upto)
        keep = [c for c in self.delta.names if c not in self.keys]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*keep), BATCH).alias("_s"))
        # Sorted in each file, so that a read of few keys skips row groups.
        out = latest.select(*[F.col(c) if c in self.keys else F.col("_s." + c).alias(c) for c in self.delta.names])
        out.sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(self._path("snapshot", upto))
        self._switch(upto)
        self.drop_old()

    def drop_old(self) -> None:
        """Drop what neither of the last two versions needs."""
        kept = self.versions()[-2:]
        for kind in ("switch", "snapshot"):
            for v in _numbers(self.spark, subdir(self.folder, kind)):
                if v < kept[0]:
                    _drop(self.spark, self._path(kind, v))
        for b in _numbers(self.spark, subdir(self.folder, "deltas")):
            if b <= kept[0]:
                _drop(self.spark, self._path("deltas", b))
