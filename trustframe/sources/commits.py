"""Small files that make a finished write visible, on any file system Spark reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def filesystem(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return filesystem(spark, path).exists(hadoop_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names of the visible entries of a folder; none if there is no such folder."""
    if not exists(spark, folder):
        return []
    found = filesystem(spark, folder).listStatus(hadoop_path(spark, folder))
    every = (f.getPath().getName() for f in found)
    return sorted(n for n in every if not n.startswith((".", "_")))


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` unless it exists; it appears whole or not at all.

    The text goes to a hidden draft first, which is renamed; file systems with
    an atomic rename that keeps an existing target (HDFS) admit one winner.
    """
    fs, target = filesystem(spark, path), hadoop_path(spark, path)
    folder, name = path.rsplit("/", 1)
    draft = hadoop_path(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(target) and fs.rename(draft, target):
        return True
    fs.delete(draft, False)
    return False
