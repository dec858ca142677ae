"""Spark session and shared-storage helpers.

Every job reads its shared scratch location from ``spark.checkpoint.dir`` so
that on a cluster intermediate files land on the shared filesystem the
operator named, never on an executor's local disk.  Only when the setting is
absent (unit tests, a laptop) do we pick a local directory ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Timestamps are naive UTC in the evidence
# (epoch values), so the session time zone is pinned to UTC; ANSI mode stays on
# and every lenient conversion uses an explicit try_* function.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bounded Arrow batches: long messages must not blow a Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.enabled": "false",
    # Reliable checkpoints are deleted once their dataset is garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "msgaudit", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's required settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Settings that are safe to change on an existing session."""
    for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
        spark.conf.set(k, BASE_CONF[k])
    # Python workers import this package from where the driver did, whatever their working directory.
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root, setting a local one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="msgaudit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory name under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/msgaudit/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Whether ``spread`` deals a table's rows out before CPU-heavy steps.  For tables that lie in a few
#: large row groups, each of which Spark reads in one task; off unless asked for.
SPREAD_CONF = "msgaudit.spread"


def spread(df):
    """The rows dealt over all cores if the session's ``msgaudit.spread`` asks for it."""
    spark = df.sparkSession
    if spark.conf.get(SPREAD_CONF, "false") != "true":
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
