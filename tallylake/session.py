"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tallylake", **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and dynamic partition overwrite.

    Shuffle width is left to AQE: pass ``spark.sql.shuffle.partitions`` for the size at hand and AQE merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # AQE skips the sorts of a join whose every partition was measured to be smaller than this
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        # pages far down a list are sorted instead of kept in memory as a top-k
        "spark.sql.execution.topKSortFallbackThreshold": "100000",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Root of the folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error, because a
    machine-local folder would lose data with its machine.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tallylake-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def release(spark: SparkSession) -> None:
    """Have Spark's context cleaner remove shuffles that nothing refers to any more.

    It does so when the driver's garbage is collected, which a driver with room to spare may put off until the disks are full. Called
    between the steps of jobs with many of them. Python tells the driver once a second what it has let go of.
    """
    gc.collect()
    for pause in (1.2, 0.5):  # seen: one round leaves the last shuffle, two remove it
        time.sleep(pause)
        spark._jvm.System.gc()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root; nothing is created until Spark writes there."""
    return f"{shared_root(spark)}/tallylake/{label}-{uuid.uuid4().hex[:12]}"
