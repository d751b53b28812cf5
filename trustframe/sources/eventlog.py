"""Append-only event log: committed batches, checked rows, newest-first reads.

Layout: ``day=<date>/batch=<attempt>/*.parquet`` beside ``_commits/<token>``.
A batch is written under a fresh attempt name and becomes visible with its
commit file, which is created only if no other has its name.  A retried append
with the same token therefore leaves its rows once, and files of an attempt
that broke off, or lost the race, are never read.

A commit holds one line per day partition of its batch: rows, smallest and
largest id, and how many rows meet each counted condition.  ``newest`` takes
from these lines the id above which enough rows lie, and reads only partitions
that reach it, so the cost of the newest n rows does not grow with the log.
Ids need not follow the days: a late row in an old day is found by its id.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialize
from . import commits

COMMITS = "_commits"
# partitions of a read named one by one; more are named by their days and joined
NAMED_PARTITIONS = 1000


class RefusedRows(ValueError):
    """A batch whose columns or values break the log's schema."""


class EventLog:
    """One log folder.  ``counted`` names the conditions that ``newest`` can ask for."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType,
                 counted: dict[str, Column] | None = None):
        self.spark, self.path, self.schema = spark, path, schema
        self.counted = counted or {}

    # ---- writing -------------------------------------------------------------

    def append(self, df: DataFrame, token: str) -> bool:
        """Add the rows of ``df`` once per ``token``; False if the token is committed already.

        Raises ``RefusedRows`` for other columns or types than the schema's,
        and for nulls where it allows none; nothing becomes visible then.
        """
        self._check_columns(df)
        commit = self._commit_path(token)
        if commits.exists(self.spark, commit):
            return False
        attempt = f"b-{uuid.uuid4().hex}"
        (df.select(*self.schema.names).withColumn("day", F.to_date("timestamp"))
           .withColumn("batch", F.lit(attempt))
           .write.mode("append").partitionBy("day", "batch").parquet(self.path))
        lines = self._partitions_of(attempt)
        return commits.publish(self.spark, commit, "".join(json.dumps(x) + "\n" for x in lines))

    def numbered(self, df: DataFrame, order: str = "timestamp") -> DataFrame:
        """``df`` with ids of its own: on from the log's largest, rising by ``order``.

        Rows are cut into ranges of ``order``; a row's id is the log's largest,
        plus the rows of the ranges before, plus its place in its range.  For
        one writer at a time: two that number at once take the same ids.
        """
        largest = self.partitions().agg(F.max("max_id")).first()[0] or 0
        ranges = materialize(df.drop("id").repartitionByRange(order)
                               .withColumn("_range", F.spark_partition_id()))
        held = ranges.groupBy("_range").agg(F.count("*").alias("_rows"))
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offset = held.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
        return (ranges.join(F.broadcast(offset), "_range")         # a row per range
                      .withColumn("id", F.lit(largest) + F.col("_before") + place)
                      .drop("_range", "_before"))

    def _check_columns(self, df: DataFrame) -> None:
        got = {f.name: f.dataType for f in df.schema.fields}
        want = {f.name: f.dataType for f in self.schema.fields}
        if got != want:
            odd = sorted(c for c in got.keys() | want.keys() if got.get(c) != want.get(c))
            raise RefusedRows(f"columns differ from the log's: {', '.join(odd)}")

    def _partitions_of(self, attempt: str) -> list[dict]:
        """One line per day of a written attempt; bounded by its days."""
        required = [f.name for f in self.schema.fields if not f.nullable]
        if not self._written(attempt):
            return []
        per_day = (self._files().where(F.col("batch") == attempt).groupBy("day").agg(
            F.count("*").alias("rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"),
            F.struct(*(F.count_if(F.col(c).isNull()).alias(c) for c in required)).alias("nulls"),
            *(F.count_if(c).alias(f"n_{name}") for name, c in self.counted.items())))
        rows = [r.asDict(recursive=True) for r in per_day.collect()]
        nulls = sorted({c for r in rows for c, n in r.pop("nulls").items() if n})
        if nulls:
            raise RefusedRows(f"null in {', '.join(nulls)}")
        return [r | {"day": str(r["day"]), "batch": attempt} for r in rows]

    # ---- reading ----------------------------------------------------------------

    def partitions(self) -> DataFrame:
        """day, batch, rows, min_id, max_id and the counts of every committed partition."""
        counts = [T.StructField(f"n_{c}", T.LongType()) for c in self.counted]
        schema = T.StructType([
            T.StructField("day", T.DateType()), T.StructField("batch", T.StringType()),
            *(T.StructField(c, T.LongType()) for c in ("rows", "min_id", "max_id")), *counts])
        folder = f"{self.path}/{COMMITS}"
        if not commits.exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(folder)

    def read(self) -> DataFrame:
        """All committed rows, with their ``day``."""
        return self._of(self.partitions())

    def total(self, what: str | None = None) -> DataFrame:
        """One row ``n``: committed rows, or those that meet a counted condition; from the commits alone."""
        n = "rows" if what is None else f"n_{what}"
        return self.partitions().agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"))

    def newest(self, n: int, what: str | None = None) -> DataFrame:
        """Rows among which the ``n`` of largest id (that meet ``what``) are, from few partitions."""
        parts = self.partitions()
        enough = F.col("rows" if what is None else f"n_{what}")
        # rows that are certain to have an id of min_id or more: those of partitions from there on
        down = Window.orderBy(F.col("min_id").desc()).rangeBetween(Window.unboundedPreceding, 0)
        bound = (parts.select("min_id", F.sum(enough).over(down).alias("above"))
                      .where(F.col("above") >= n).agg(F.max("min_id")).first()[0])
        if bound is None:
            return self._of(parts)
        return self._of(parts.where(F.col("max_id") >= bound)).where(F.col("id") >= bound)

    def _of(self, parts: DataFrame) -> DataFrame:
        """The rows of the given partitions, pruned before the scan."""
        named = parts.select("day", "batch").limit(NAMED_PARTITIONS + 1).collect()
        if not named:
            return self.spark.createDataFrame([], self._file_schema()).drop("batch")
        if len(named) > NAMED_PARTITIONS:
            first = parts.agg(F.min("day")).first()[0]
            rows = self._files().where(F.col("day") >= F.lit(first))
            return rows.join(parts.select("day", "batch"), ["day", "batch"], "left_semi").drop("batch")
        days = sorted({r["day"] for r in named})
        batches = sorted({r["batch"] for r in named})
        return self._files().where(F.col("day").isin(days) & F.col("batch").isin(batches)).drop("batch")

    # ---- files ------------------------------------------------------------------

    def _file_schema(self) -> T.StructType:
        return T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema.fields),
                             T.StructField("day", T.DateType()),
                             T.StructField("batch", T.StringType())])

    def _files(self) -> DataFrame:
        return self.spark.read.schema(self._file_schema()).parquet(self.path)

    def _written(self, attempt: str) -> bool:
        """Whether an attempt left any file (an empty batch has none)."""
        found = commits.filesystem(self.spark, self.path).globStatus(
            commits.hadoop_path(self.spark, f"{self.path}/day=*/batch={attempt}"))
        return found is not None and len(found) > 0

    def _commit_path(self, token: str) -> str:
        return f"{self.path}/{COMMITS}/{hashlib.sha256(token.encode()).hexdigest()}.json"
