"""Structured Streaming forms of the scoring and log-analytics jobs.

* hourly / daily call counts: tumbling ``window`` + watermark (state bounded
  by the watermark; late rows beyond it are dropped);
* unique installs: ``dropDuplicatesWithinWatermark`` on the extension id, and its
  windowed count as a second stateful step (append mode, state in RocksDB);
* stream scoring: stateless validate/score per micro-batch, two sinks written
  from ``foreachBatch``, idempotent by batch id (a replayed batch overwrites
  its own partition).

Sinks and checkpoints live under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), so a restarted driver or lost executor resumes
from the last committed batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

HOUR_DELAY = "1 hour"       # fixed value: production lateness bound of the log windows
INSTALL_HORIZON = "31 days"  # dedupe horizon of extension ids
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream one Parquet table (``<folder>/<name>.parquet``) as it is appended to.

    A table written by Spark is a folder: every file in it, and every file
    added later, is streamed.  A table of one file is found by its name.
    ``max_files`` bounds the files of one batch; the default takes all that are
    there, because a backlog's files need not be in event-time order and a
    watermark moved by one of them would drop rows of the next.
    """
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).format("parquet")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return reader.load(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").load(folder)


def with_event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ); the session zone is UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def windowed_calls(calls: DataFrame, size: str, delay: str = HOUR_DELAY) -> DataFrame:
    """Calls per tumbling window (errors included) and mean latency of successful calls."""
    ok_rt = F.when(F.col("error") == 0, F.col("response_time_ms"))
    return (with_event_time(calls).withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", size).alias("w"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(ok_rt).alias("avg_ms")))


def unique_install_events(pings: DataFrame, horizon: str = INSTALL_HORIZON) -> DataFrame:
    """First ping of each extension id within the watermark horizon."""
    return (with_event_time(pings).filter(F.col("extension_id").isNotNull())
            .withWatermark("timestamp", horizon)
            .dropDuplicatesWithinWatermark(["extension_id"]))


def install_counts(pings: DataFrame, size: str = "1 day", horizon: str = INSTALL_HORIZON) -> DataFrame:
    """New installs per window (``w``, ``new_installs``): two chained stateful steps.

    The first ping of an id passes the deduplication and is counted in its
    window; a window is emitted once the watermark has passed it, so its count
    is final (append mode).  An id that returns after the horizon counts again.
    """
    return (unique_install_events(pings, horizon).groupBy(F.window("timestamp", size).alias("w"))
            .agg(F.count(F.lit(1)).alias("new_installs")))


def active_installs(pings: DataFrame, size: str = "1 day", delay: str = HOUR_DELAY) -> DataFrame:
    """Different ids per window (``w``, ``installs``), emitted once when the watermark passes it."""
    seen = (with_event_time(pings).filter(F.col("extension_id").isNotNull())
            .withWatermark("timestamp", delay)
            .select("extension_id", F.window("timestamp", size).alias("w"))
            .dropDuplicates(["extension_id", "w"]))
    return seen.groupBy("w").agg(F.count(F.lit(1)).alias("installs"))


def rocksdb_state(spark: SparkSession) -> None:
    """Keep the state of streams started from now on in RocksDB, outside the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _upsert_sink(path: str):
    """foreachBatch writer: each batch lands in its own partition (replay-safe)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))
    return write


def run_available(df: DataFrame, name: str, mode: str = "update", key_cols=None) -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) and read the result.

    Output rows of later batches replace earlier ones per ``key_cols``
    (update-mode semantics); without keys every row is kept.
    """
    spark = df.sparkSession
    base = scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"
    q = (df.writeStream.outputMode(mode).foreachBatch(_upsert_sink(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.parquet(out)
    if key_cols:
        latest = Window.partitionBy(*key_cols)
        res = (res.withColumn("_last", F.max("batch_id").over(latest))
               .filter(F.col("batch_id") == F.col("_last")).drop("_last"))
    return res.drop("batch_id")


def scoring_batch_writer(scored_path: str, log_path: str):
    """foreachBatch body of stream scoring: scored rows + call-log rows, idempotent."""
    from ..operators.calllog import call_log_rows

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(scored_path))
            # a stream without measured latencies logs none: averages skip NULL, not 0
            timed = batch if "response_time_ms" in batch.columns else \
                batch.withColumn("response_time_ms", F.lit(None).cast("double"))
            logs = call_log_rows(timed).withColumn("day", F.to_date("timestamp"))
            (logs.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(log_path))
        finally:
            batch.unpersist()
    return write
