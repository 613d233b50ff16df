"""Session settings and the shared checkpoint folder.

Everything here is configuration a Spark user sets anyway; nothing replaces
Spark's own planner or scheduler.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins with measured shuffle
# sizes (runtime broadcast of small sides, skew-join splitting of hot keys,
# partition coalescing), so no join in this package hard-codes a strategy
# except for relations whose size is fixed by the code itself.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where that adds a shuffle afterwards
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches for the few Python steps (page parser, NFKD, archives):
    # bounded in rows and in bytes, since one landed page can be large.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "regiflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local-mode session (tests) may get a folder of its own when the
    setting is missing; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            root = None
    root = root or sc.getCheckpointDir()        # set before in this session
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="regiflow-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def stream_checkpoint_path(spark: SparkSession, name: str) -> str:
    """The stable checkpoint folder of the stream ``name``: the same on
    every start, so a restarted stream resumes where it stopped."""
    return os.path.join(checkpoint_root(spark), "streams", name)


def fresh_checkpoint_path(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared checkpoint root for one run of ``name``."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
