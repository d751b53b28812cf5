"""Parallel running sums (prefix sums) without a single-task window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Here the order key is cut into ordered ranges at approximate quantiles
(``percentile_approx``; only the split points reach the driver, as with Spark's
own range partitioner).  The number of ranges follows from the counted rows, so
a task holds about ``ROWS_PER_RANGE`` of them however many there are.  Then:

1. per-range totals: a grouped aggregate with one row per range and group;
2. range offsets: a window over that bounded table;
3. running sums inside the ranges: a window partitioned by range, i.e. one task
   per range, all in parallel; offset + running = global prefix sum.

Rows with equal order keys always fall in the same range, so the result is
exact; the split points only affect balance, never values.  Intended for
inputs that are already aggregated to one row per order key (score or value
histograms), where duplicates of a hot value have been combined map-side.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ROWS_PER_RANGE = 200_000
LEAST_RANGES = 16            # small inputs still use several tasks


def ranges_for(rows: int, per_range: int = ROWS_PER_RANGE) -> int:
    """How many ranges keep a range of ``rows`` rows near ``per_range``."""
    return max(LEAST_RANGES, -(-rows // per_range))


def _split_points(df: DataFrame, order: str, groups: tuple[str, ...], n: int) -> list:
    probs = [i / n for i in range(1, n)]
    sk = df.groupBy(*groups).agg(F.percentile_approx(order, probs, 10 * n).alias("_splits"))
    return sk.collect()  # (#groups) x (n - 1) numbers


def _below(splits: Column, heads: Column, step: int, v: Column) -> Column:
    """How many split points are below ``v``: whole steps first, then inside one."""
    whole = F.greatest(F.size(F.filter(heads, lambda s: s < v)) - 1, F.lit(0)) * step
    rest = F.filter(F.slice(splits, whole + 1, F.lit(step)), lambda s: s < v)
    return whole + F.size(rest)


def with_ranges(df: DataFrame, order: str, groups: tuple[str, ...] = (), descending: bool = False,
                per_range: int = ROWS_PER_RANGE, n_buckets: int | None = None) -> DataFrame:
    """``df`` with ``_b``, the ordered range of the row in its group."""
    n = n_buckets or ranges_for(df.count(), per_range)
    kind = f"array<{df.schema[order].dataType.simpleString()}>"
    points = [(*(r[g] for g in groups), sorted(set(r["_splits"] or [])))
              for r in _split_points(df, order, groups, n)]
    step = max(1, math.isqrt(n))
    if groups:
        schema = T.StructType([*(df.schema[g] for g in groups),
                               T.StructField("_splits", T.ArrayType(df.schema[order].dataType)),
                               T.StructField("_heads", T.ArrayType(df.schema[order].dataType))])
        table = df.sparkSession.createDataFrame([(*p, p[-1][::step]) for p in points], schema)
        cut = df.join(F.broadcast(table), list(groups))
    else:
        found = points[0][-1] if points else []
        cut = df.withColumns({name: F.array(*map(F.lit, x)).cast(kind)
                              for name, x in (("_splits", found), ("_heads", found[::step]))})
    below = _below(F.col("_splits"), F.col("_heads"), step, F.col(order))
    bucket = (F.size("_splits") - below) if descending else below
    return cut.withColumn("_b", bucket).drop("_splits", "_heads")


def running_sums(df: DataFrame, order: str, value_cols: list[str], *,
                 descending: bool = False, groups: tuple[str, ...] = (),
                 per_range: int = ROWS_PER_RANGE, n_buckets: int | None = None,
                 prefix: str = "cum_") -> DataFrame:
    """Add inclusive running sums ``cum_<v>`` of ``value_cols`` in ``order`` order.

    ``n_buckets`` sets the number of ranges; by default it follows from the rows.
    ``groups`` restart the sums per group (the group count must be small,
    e.g. a feature name); rows with equal ``order`` in a group must be
    pre-combined by the caller.
    """
    v = F.col(order)
    b = with_ranges(df, order, groups, descending, per_range, n_buckets)
    totals = b.groupBy(*groups, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_b", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in value_cols])

    key = v.desc() if descending else v.asc()
    within = Window.partitionBy(*groups, "_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(F.broadcast(offsets), [*groups, "_b"])
    return out.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_o_{c}") + F.sum(c).over(within)).alias(f"{prefix}{c}") for c in value_cols],
    )
