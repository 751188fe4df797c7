"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library needs: times are UTC without a zone, and AQE splits skewed joins,
# coalesces small shuffle partitions and turns joins into broadcasts only after it has seen the real size.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot station in a join even if the next step then needs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # streaming state on local disk with changes uploaded to the checkpoint, not in executor memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# Only for the small local sessions made here.
LOCAL_SETTINGS = {
    # plans are built by many small calls, each of which would record its call site
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # merge shuffle partitions by size, even below the number of cores
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
}


def local_session(
    app: str, cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in (SETTINGS | LOCAL_SETTINGS).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else made; all of them can be changed at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Bytes of scanned files per shuffle partition to start with; AQE merges those that turn out small.
SHUFFLE_BYTES = 128 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, *inputs: DataFrame, bytes_per_partition: int = SHUFFLE_BYTES) -> int:
    """Let exchanges start with enough partitions for the largest of the inputs, known from their files without a job; returns the number.

    A call of whoever owns the session: a fixed `spark.sql.shuffle.partitions` that fits a test would give partitions of many gigabytes on a large table.
    A number that the user has set is left alone.
    """
    sizes = [int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for f in inputs]
    wanted = max([-(-size // bytes_per_partition) for size in sizes], default=0)
    wanted = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if spark.conf.get(INITIAL_PARTITIONS, None) is None:
        spark.conf.set(INITIAL_PARTITIONS, str(wanted))
    return int(spark.conf.get(INITIAL_PARTITIONS))


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: `spark.checkpoint.dir`; a local folder only if unset on a local master."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "dockpulse-shared")
    return f"{base.rstrip('/')}/dockpulse/{context.applicationId}"
