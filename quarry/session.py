"""Session settings the operators rely on.

The operators are plain DataFrame functions and work on any session; these
settings only pin the semantics they were verified under (UTC dates, ANSI
arithmetic, AQE for runtime join/skew decisions, last-wins map merges).
"""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings applied to every session we build or are handed.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings for the scale behaviour: AQE re-plans joins on real sizes, splits
# skewed shuffle partitions and coalesces small ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Wide one-pass aggregates (profiles, correlation matrices) keep whole-stage codegen.
    "spark.sql.codegen.maxFields": "4000",
    # Rows and bytes sent to Python at once: bounds the memory of workers on long texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantic and scale settings to an existing session."""
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    importable(spark)
    ensure_checkpoint_dir(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """The Python workers' environment: this package where the driver found it (on a cluster, ship it with ``--py-files``)."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    # Workers are reused from stage to stage: large blocks go back to the system when freed.
    env.update({"MALLOC_MMAP_THRESHOLD_": "131072", "MALLOC_TRIM_THRESHOLD_": "131072", "MALLOC_ARENA_MAX": "2",
                "ARROW_DEFAULT_MEMORY_POOL": "system"})
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))


def local_session(cores: int = 8, app: str = "quarry", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
    )
    for key, value in {**SEMANTIC_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder, which is
    used as is. Only in local mode, where one machine holds everything, a
    private folder is created when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cluster_settings(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Starting values for a large cluster run, sized from the input volume.

    Shuffle partitions are chosen so that one partition of the largest
    shuffle holds about ``target_partition_bytes`` (spill-free on a few GB of
    executor memory) and at least two waves of tasks exist; AQE then
    coalesces small partitions and splits skewed ones at runtime.
    """
    partitions = max(2 * executor_cores_total, input_bytes // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(int(partitions)),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
