"""Session construction and cluster-safe helpers (checkpoint folder, package shipping)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings for a large cluster (about 1000 executors, ~100 TB of parquet input).
# Initial shuffle partitions are set high and AQE coalesces them to ~256 MB;
# hot keys are split by AQE's skew join and by the chunked / salted operators;
# broadcasts happen only when measured sizes (AQE runtime stats) are small.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
    # executor loss: retry tasks and stages, move shuffle blocks off decommissioning nodes
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.storage.decommission.rddBlocks.enabled": "true",
    "spark.ui.enabled": "false",
}


def cluster_spark(app: str = "tierlens") -> SparkSession:
    """Session for a cluster run: master, executors and ``spark.checkpoint.dir``
    (a shared folder) come from spark-submit; :data:`CLUSTER_CONF` fills only
    keys the submitter left unset."""
    from pyspark import SparkConf, SparkContext

    SparkContext._ensure_initialized()  # JVM up, so the submitter's settings are visible
    builder = SparkSession.builder.appName(app)
    given = SparkConf()
    for k, v in CLUSTER_CONF.items():
        if not given.contains(k):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
    checkpoint_dir(spark)
    ship(spark)
    return spark


def get_spark(master: str | None = None, app: str = "tierlens", shuffle_partitions: int = 8) -> SparkSession:
    """Local/test session. On a cluster, spark-submit supplies master and sizing."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIERLENS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests) gets a scratch folder of its own; on a cluster
    a folder that the driver alone can see would lose data, so none is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if current:
        if not sc_dir:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if sc_dir:
        return sc_dir
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tierlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def literal_dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed dimension table from code constants; its size is known, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application: functions that
    run there are pickled by name and need it importable."""
    import shutil
    import sys

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tierlens-package"), "zip", root, "tierlens")
    path = list(sys.path)
    sc.addPyFile(archive)  # also puts the archive on the driver's own path, which has the package already
    sys.path[:] = path
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the shared checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tierlens-scratch/{name}-{uuid.uuid4().hex[:12]}"
