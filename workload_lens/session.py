"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


# The text work is heavy for its bytes, so small shuffles should still use every core.
TUNING = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session that somebody else has built."""
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "workload-lens", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides them."""
    settings = {
        **TUNING,
        # Recording the call site of every column expression slows down building large plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        # State of open windows on local disk, with changes uploaded to the checkpoint.
        "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str | None:
    """A new folder under the checkpoint folder that the cluster shares.

    Without such a setting there is one only in local mode; on a cluster the result is
    ``None``, because a machine-local folder is not visible to the other machines.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            return None
        base = tempfile.mkdtemp(prefix="workload-lens-")
    return f"{base.rstrip('/')}/workload-lens-{uuid.uuid4().hex}"
