"""Session construction and shared-storage helpers.

Everything in the library takes a ``SparkSession`` from the caller; this
module only provides a sensible default builder for tests, benches and
scripts, and the lookup of the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC for all date/time text, AQE for runtime
# re-planning (partition coalescing, skew-join splitting, broadcast choice
# from real sizes), ANSI arithmetic (Spark 4 default) left on.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "trustframe",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's base settings."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(shuffle_bytes: int, target_partition_bytes: int = 256 << 20,
                 executors: int = 1000, cores_per_executor: int = 4) -> dict:
    """Settings for a large cluster, sized from the expected shuffle volume.

    ``shuffle_bytes`` is the data crossing the largest exchange after
    projection and partial aggregation (far below the raw input for these
    jobs).  Shuffle partitions start at shuffle / 256 MiB, at least two waves
    of the cluster's cores, and AQE coalesces them at run time toward the same
    advisory size; scan splits use the same target; partitions more than 5x
    the median and above 512 MiB are split by the skew-join rule.
    """
    cores = executors * cores_per_executor
    parts = max(2 * cores, int(shuffle_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must point at shared storage and is used as is;
    without it a job there fails at once.  Only a local session gets a private
    folder, which is removed when the process ends.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(
            spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="trustframe-ckpt-")
        atexit.register(shutil.rmtree, d, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediates."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df):
    """Write a reused intermediate once to the shared checkpoint folder.

    Used for small aggregated frames (score/value histograms) that several
    later steps read: the upstream scan runs once, and the lineage is cut so
    a lost executor recomputes from the checkpoint, not from the source.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
