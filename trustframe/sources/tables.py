"""File scans and sinks: account/label/split tables, images, run artefacts."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import require_columns
from ..schemas import ACCOUNTS_SCHEMA, LABELS_SCHEMA, SPLIT_SCHEMA
from . import commits

VERSIONS = "_versions"
DEFAULT_THRESHOLD = 0.30   # fixed value: decision threshold when a run has none


def _read(spark: SparkSession, path: str, schema, fmt: str) -> DataFrame:
    """Columns of the schema in its types; a value that does not fit is null, as in a CSV scan.

    Parquet files keep their own types, so the cast follows the scan; columns
    the files lack are null, others are left out.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        have = set(df.columns)
        return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in have
                            else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))
    return spark.read.schema(schema).option("header", True).csv(path)


def read_accounts(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, ACCOUNTS_SCHEMA, fmt)


def read_labels(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "parquet":
        require_columns(spark.read.parquet(path), ["id", "label"])
        return _read(spark, path, LABELS_SCHEMA, fmt)
    return require_columns(spark.read.option("header", True).csv(path), ["id", "label"])


def maybe_split(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame | None:
    """Optional split file: missing path or unknown columns -> None (use all labels)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).csv(path)
    if not {"id", "split"}.issubset(df.columns):
        return None
    return _read(spark, path, SPLIT_SCHEMA, fmt) if fmt == "parquet" else df


def write_accounts(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Decoded images (path, width, height, ...) and a quarantine of undecodable files.

    Spark's image source yields BGR bytes; undecodable files come back with
    height -1 when ``dropInvalid`` is off.
    """
    img = spark.read.format("image").option("dropInvalid", False).load(path)
    flat = img.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"),
                      F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"),
                      F.col("image.data").alias("data"))
    return flat.filter(F.col("height") > 0), flat.filter(F.col("height") <= 0).select("path")


def save_run(model, summary: dict, run_dir: str, spark: SparkSession,
             features: list[str] | None = None) -> int:
    """Persist the model, a one-row JSON summary (threshold included) and the feature schema.

    ``model`` is a fitted pipeline or the (base, calibrator) members of a
    calibrated one, each saved in a folder of its own.  A save writes a folder
    that no other uses and becomes a version of the run with its commit file,
    so readers see the whole of it or the version before.  Returns the version.
    """
    attempt = f"saved/{uuid.uuid4().hex}"
    members = model if isinstance(model, list) else [(model, None)]
    for i, pair in enumerate(members):
        for name, part in zip(("base", "calibrator"), pair):
            if part is not None:
                part.write().save(f"{run_dir}/{attempt}/model/{i}/{name}")
    kinds = [[type(p).__name__ if p is not None else None for p in pair] for pair in members]
    for name, value in (("summary", summary), ("schema", {
            "feature_list": features, "members": kinds, "train_rows": summary.get("train_rows"),
            "test_rows": summary.get("test_rows"), "best_params": summary.get("best_params")})):
        spark.createDataFrame([(json.dumps(value),)], "value string") \
            .coalesce(1).write.text(f"{run_dir}/{attempt}/{name}")
    version = max(versions(spark, run_dir), default=0) + 1
    while not commits.publish(spark, f"{run_dir}/{VERSIONS}/{version:09}", attempt):
        version += 1
    return version


def versions(spark: SparkSession, run_dir: str) -> list[int]:
    """The committed versions of a run, ascending."""
    return [int(n) for n in commits.names(spark, f"{run_dir}/{VERSIONS}") if n.isdigit()]


def _saved_at(spark: SparkSession, run_dir: str, version: int | None) -> str:
    """The folder of a version, by default the newest."""
    known = versions(spark, run_dir)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed run {'' if version is None else version} in {run_dir}")
    path = f"{run_dir}/{VERSIONS}/{known[-1] if version is None else version:09}"
    return f"{run_dir}/{spark.read.text(path).first()[0]}"


def _json_of(spark: SparkSession, path: str) -> dict:
    try:
        line = spark.read.text(path).first()
        return json.loads(line[0]) if line else {}
    except (AnalysisException, ValueError):     # no such file, or not JSON
        return {}


def load_run(run_dir: str, spark: SparkSession, default_threshold: float = DEFAULT_THRESHOLD,
             version: int | None = None):
    """(model or members, summary, threshold, schema) of the newest or a given version.

    The threshold falls back to 0.30.
    """
    run_dir = _saved_at(spark, run_dir, version)
    from pyspark.ml import PipelineModel
    from pyspark.ml.regression import IsotonicRegressionModel
    from ..plans.training import GrownForest
    kinds = {"PipelineModel": PipelineModel, "IsotonicRegressionModel": IsotonicRegressionModel,
             "GrownForest": GrownForest}
    schema = _json_of(spark, f"{run_dir}/schema")
    parts = [tuple(kinds[k].load(f"{run_dir}/model/{i}/{name}") if k else None
                   for name, k in zip(("base", "calibrator"), pair))
             for i, pair in enumerate(schema.get("members") or [["PipelineModel", None]])]
    model = parts if parts[0][1] is not None else parts[0][0]
    summary = _json_of(spark, f"{run_dir}/summary")
    try:
        th = float(summary.get("optimal_threshold", default_threshold))
    except (TypeError, ValueError):
        th = default_threshold
    return model, summary, th, schema
