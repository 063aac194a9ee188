"""SparkSession helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library depends on. AQE re-plans joins (broadcast only when
# the runtime size is below the threshold), coalesces small shuffle
# partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# HotSpot never compiles a method of more than 8,000 bytes, and large ones late: a stage that would be generated as such
# a method (the cleaning of 48 columns is) runs its expressions in split functions instead.
HUGE_METHOD = {"spark.sql.codegen.hugeMethodLimit": "4000"}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def get_spark(master: str | None = None, app_name: str = "nextbuy",
              shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **HUGE_METHOD}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle and scan sizing for a large cluster, from the input size.

    Starts with enough shuffle partitions for ~``target_partition_bytes``
    each (AQE coalesces them at run time toward the advisory size), reads
    files in 256 MB splits, and lets AQE split skewed join partitions.
    """
    partitions = max(200, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def prepare_session(spark: SparkSession) -> SparkSession:
    """Settings the results depend on, for a session created elsewhere:
    UTC session time (month boundaries of timestamps), generated code that gets compiled, a checkpoint folder and
    the package's place for Python workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for k, v in HUGE_METHOD.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (else ship it with --py-files)."""
    try:
        env = spark.sparkContext.environment
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no SparkContext
        return
    root, paths = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    # whole texts travel to the workers: Spark's default of 10,000 rows a batch takes too much memory
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def _is_local(spark: SparkSession) -> bool:
    """True when driver and executors share one machine (and so its temp folder)."""
    try:
        return spark.sparkContext.master.split("[")[0] == "local"
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no SparkContext
        return False


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Uses ``spark.checkpoint.dir`` from the session. Only when nothing is
    configured and the master is local (tests) a folder of our own is
    created; on a cluster a missing setting is an error, because a
    machine-local folder is not seen by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a remote (Connect) session has no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc else None
    if current:
        return current
    if not configured:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="nextbuy-ckpt-")
    if sc:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def shared_output_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables, under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name
