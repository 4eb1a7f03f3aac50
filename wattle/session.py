"""Session construction and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Defaults suited to the engine's workloads; every one can be overridden by the cluster config.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the regression's moment aggregate keeps ~220 buffer fields; above the default of 100
    # whole-stage codegen is switched off for it (measured 1.5x slower at sf0.1)
    "spark.sql.codegen.maxFields": "1000",
    # checkpoints of iterative inputs are removed once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "wattle", conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    The cluster names it in ``spark.checkpoint.dir``; only a local-mode session without
    one (tests) gets a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        current = tempfile.mkdtemp(prefix="wattle-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.urandom(6).hex()}")


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used for inputs of iterative jobs: a lost executor then re-reads the checkpoint
    instead of replaying the scan and shuffles that built the input.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that must use the whole cluster: the larger of the configured
    shuffle partitions and the total task slots."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Partitions for ``rows`` rows that are sorted or grouped in memory: as many as the cluster
    works on, and more as soon as a task would hold over ``rows_per_task`` of them."""
    return max(parallelism(spark), -(-rows // rows_per_task))


def spread(df: DataFrame, n: int | None = None) -> DataFrame:
    """Round-robin the rows over ``n`` partitions (default: ``parallelism``).

    For inputs of iterative or CPU-heavy stages: adaptive execution sizes partitions by
    shuffle bytes, which can leave a small-but-expensive table (e.g. the K-SC points) in a
    single task. An explicit count is kept as is; round-robin after Spark's local sort is
    deterministic, so a retried task sees the same rows.
    """
    return df.repartition(n or parallelism(df.sparkSession))
