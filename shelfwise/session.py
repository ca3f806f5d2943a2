"""SparkSession construction with the settings every job here relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness (UTC day boundaries, ANSI decimal
# overflow errors) and for scale (AQE coalescing / skew splitting / runtime
# broadcast decided on measured sizes rather than on hints).
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Broadcast decisions: at planning time only under Spark's conservative
    # default (plan-time sizes are estimates - joins are estimated as the
    # product of their inputs), at run time (AQE) on the *measured* size of
    # a materialized shuffle, up to 32 MB. Everything else stays a shuffle
    # join; no query forces a broadcast of a table that grows with the data.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "shelfwise",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session with ``BASE_CONF`` applied.

    ``shuffle_partitions`` defaults to Spark's own value; on a cluster set it
    to roughly (shuffle bytes / 128 MB) and let AQE coalesce downwards.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in conf.items():
        if not key.startswith("spark.ui") and not key.startswith("spark.driver"):
            try:
                spark.conf.set(key, value)
            except Exception:  # static confs of an already running session
                pass
    spark.sparkContext.setLogLevel("WARN")
    return spark


def footer_session(spark: SparkSession) -> SparkSession:
    """A child session (same SparkContext, own SQL conf) that reads Parquet with
    aggregate push-down: COUNT, MIN and MAX over plain columns without a filter
    are answered from the file footers, and no row group is read. Other queries
    are better off with the default reader, so it is a session of its own."""
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():  # inherit the caller's SQL settings
        if key.startswith("spark.sql.") and child.conf.isModifiable(key):
            child.conf.set(key, value)
    v1 = [x for x in child.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet"]
    child.conf.set("spark.sql.sources.useV1SourceList", ",".join(v1))
    child.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return child


def checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Jobs cut lineage or keep streaming state only under this folder. When it
    is unset (a test session) and ``local_fallback`` is true, a fresh
    directory under the system temp folder is created and registered; on a
    cluster the setting must be provided, so this raises instead.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (local_fallback and sc.master.startswith("local")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running jobs that checkpoint"
        )
    path = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def subdir(base: str, name: str) -> str:
    """Join a child folder onto a checkpoint base that may be a URI."""
    if "://" in base:
        return base.rstrip("/") + "/" + name
    return os.path.join(base, name)
