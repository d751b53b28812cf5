"""Mergeable value sketches: describe many days from small per-day tables.

A sketch is a table of counts per logarithmic bucket: bucket i holds the values
in (g^(i-1), g^i] with g = (1 + ``ERROR``) / (1 - ``ERROR``), negative values
mirrored, zero by itself.  Every value of a bucket lies within ``ERROR`` of its
representative, so a quantile is off by at most that share of the exact one.
Buckets also keep sum, sum of squares, smallest and largest value.  Merging adds
counts and sums: the sketch of a month is that of its days' sketches, bucket by
bucket, whatever the order.  A feature has about 50 buckets per power of ten.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .profilestats import DESCRIBE_PROBS, long_form

ERROR = 0.02
GROWTH = (1 + ERROR) / (1 - ERROR)
SHIFT = 1_000_000          # keeps the exponent part of a bucket number positive


def bucket_of(v: Column) -> Column:
    """Bucket number: the sign times (exponent + ``SHIFT``), 0 for zero."""
    exponent = F.ceil(F.log(F.abs(v)) / F.lit(math.log(GROWTH)))
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * (exponent + SHIFT)).cast("long")


def value_of(bucket: Column) -> Column:
    """Representative of a bucket: within ``ERROR`` of all its values."""
    size = F.pow(F.lit(GROWTH), F.abs(bucket) - SHIFT) * (2 / (GROWTH + 1))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket) * size)


def _merged(rows: DataFrame, by: tuple[str, ...], c, s, q, lo, hi) -> DataFrame:
    return rows.groupBy(*by, "feature", "bucket").agg(
        F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(q).alias("q"), F.min(lo).alias("lo"),
        F.max(hi).alias("hi"))


def sketch(df: DataFrame, cols, by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature, bucket, c, s, q, lo, hi; nulls and NaN are left out."""
    v = F.col("value")
    rows = long_form(df, cols, by).where(v.isNotNull() & ~F.isnan(v)).withColumn("bucket", bucket_of(v))
    return _merged(rows, by, F.lit(1), v, v * v, v, v)


def merge(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The sketch per ``by`` of finer sketches."""
    return _merged(sketches, by, "c", "s", "q", "lo", "hi")


def describe(merged: DataFrame, probs=DESCRIBE_PROBS) -> DataFrame:
    """feature, count, mean, sample sd, min, percentiles, max of a sketch without ``by``.

    The percentiles interpolate between the representatives at the two ranks
    around, like the exact ones between values.
    """
    so_far = Window.partitionBy("feature").orderBy("bucket")        # the buckets of one feature
    whole = Window.partitionBy("feature")
    b = merged.select("feature", "bucket", "c", F.sum("c").over(so_far).alias("cum"),
                      F.sum("c").over(whole).alias("n"), F.min("lo").over(whole).alias("lo"),
                      F.max("hi").over(whole).alias("hi"))
    at = F.greatest("lo", F.least("hi", value_of(F.col("bucket"))))

    def quantile(p: float) -> Column:
        pos = F.lit(p) * (F.col("n") - 1)
        low, high = (F.min_by(at, F.when(F.col("cum") > r, F.col("bucket"))) for r in (F.floor(pos), F.ceil(pos)))
        return low + (high - low) * F.max(pos - F.floor(pos))

    quantiles = b.groupBy("feature").agg(*(quantile(p).alias(f"p{round(p * 100)}") for p in probs))
    n, s = F.sum("c"), F.sum("s")
    spread = F.greatest(F.sum("q") - s * s / n, F.lit(0.0))
    basic = merged.groupBy("feature").agg(
        n.alias("count"), (s / n).alias("mean"), F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"),
        F.min("lo").alias("min"), F.max("hi").alias("max"))
    return basic.join(quantiles, "feature")
