"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trustframe.session import checkpoint_dir

# bytes of one Arrow batch sent to a Python worker; bounds its memory when texts are long
ARROW_BATCH_BYTES = 2 << 20
ARROW_BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where they see its folder.

    Workers inherit the driver's working folder and PYTHONPATH, not its
    ``sys.path``.  On a cluster without the folder, submit it with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and by bytes (texts may be very long)."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts lineage on storage that every executor sees, so a lost executor costs
    a read of the table and not its recomputation.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def append_columns(df: DataFrame, keep: list[str], text: str, fields: list[T.StructField],
                   rows: Callable[[list[bytes]], Iterator[list]]) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields`` computed from each text.

    A kept column with the name of an added one gives way to it.
    ``rows`` maps the texts of one Arrow batch to one value list per field.
    The pass runs where the rows are: no shuffle, one batch in memory.
    """
    bounded_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name in set(keep) - {f.name for f in fields}]
    schema = T.StructType([*kept, *fields])
    types = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in batches:
            got = rows(utf8(batch.column("__text")))
            new = [pa.array(v, t) for v, t in zip(got, types)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *new], names=names)

    return df.select(*(f.name for f in kept), F.col(text).alias("__text")).mapInArrow(run, schema)


def rows_where(df: DataFrame, text: str, make: Callable[[DataFrame, list[str], str], DataFrame],
               condition: str) -> DataFrame:
    """The rows of ``df``, unchanged, for which ``condition`` holds on the columns ``make`` adds.

    ``make`` gets the columns under neutral names, so no name of ``df`` can
    clash with an added one.
    """
    names = [f"__c{i}" for i in range(len(df.columns))]
    safe = df.toDF(*names)
    found = make(safe, names, names[df.columns.index(text)]).where(condition)
    return found.select(*names).toDF(*df.columns)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, salt_of: Column,
                  salts: int = 16) -> DataFrame:
    """Left join on ``key`` where one key may hold a third of the left rows.

    ``right`` is unique on ``key`` and narrow; each of its rows is repeated
    ``salts`` times, and every left row picks one copy by ``salt_of``.  Null
    keys meet null keys.
    """
    r = right.select(F.col(key).alias("__k"), *(c for c in right.columns if c != key),
                     F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__rs"))
    lt = left.withColumn("__s", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    return (lt.join(r, lt[key].eqNullSafe(r["__k"]) & (lt["__s"] == r["__rs"]), "left")
              .drop("__s", "__rs", "__k"))
