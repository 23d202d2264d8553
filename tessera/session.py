"""Session and shared-scratch helpers.

Everything that writes intermediate data (CSV round trips, saved models,
the run log) goes under the shared folder named by ``spark.checkpoint.dir``.
The setting is read from the running session. Only where it is unset *and* the
master is local, a folder beside the session's warehouse takes its place (tests may
name another in ``TESSERA_LOCAL_CHECKPOINT_DIR``); a cluster must set it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

_LOCAL_CKPT_ENV = "TESSERA_LOCAL_CHECKPOINT_DIR"


def get_session(master: str | None = None, app: str = "tessera", shuffle_partitions: int = 8) -> SparkSession:
    """Session with the settings the library expects (AQE on, UI off, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Local mode runs everything in the driver JVM; its heap is the only memory knob.
            builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "12g"))
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Order: the SparkContext's checkpoint dir, then the ``spark.checkpoint.dir``
    setting. Only when both are unset and the master is local another folder is
    registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir() or d
    if not d and sc.master.startswith("local") and (d := os.environ.get(_LOCAL_CKPT_ENV)):
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    if not d and sc.master.startswith("local"):
        # One machine, one process: nothing to share. A cluster must name its folder.
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
        d = sc.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder every executor can reach")
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera/{name}-{uuid.uuid4().hex[:12]}"
