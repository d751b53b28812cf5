"""Isotonic calibration whose pooling runs on the executors.

The isotonic fit of weighted targets in score order is the slope of the lower
convex hull of their running sums (weight so far, weighted target so far).  A
point inside the hull of its score range is inside the hull of all, so each
range keeps its own hull's corners first; only those are joined into one hull.
They number about the levels of the fitted step function, which the model holds
in any case.

``pooled`` gives two rows per level, its first and last score, on which MLlib's
estimator fits the same function as on all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ROWS_PER_RANGE, running_sums, with_ranges

CORNERS = "x double, y double, first double, last double"


def corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the lower hull's corners among points of rising ``x``, both ends included."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            # b stays if the slope after it is larger than the one before
            if (y[b] - y[a]) * (x[i] - x[b]) < (y[i] - y[b]) * (x[b] - x[a]):
                break
            kept.pop()
        kept.append(i)
    return np.array(kept, np.int64)


def _range_hull(rows):
    """Corners of one range (a pandas group): running sums and the scores beside each corner."""
    import pandas as pd

    rows = rows.sort_values("s")
    w, t, s = (rows[c].to_numpy() for c in ("cum_w", "cum_t", "s"))
    before = (w[0] - rows["w"].iloc[0], t[0] - rows["t"].iloc[0])
    x, y = np.concatenate(([before[0]], w)), np.concatenate(([before[1]], t))
    at = corners(x, y)
    # a corner ends the level of the score before it and starts that of the score after it
    last = np.concatenate(([np.nan], s))[at]
    first = np.concatenate((s, [np.nan]))[at]
    return pd.DataFrame({"x": x[at], "y": y[at], "first": first, "last": last})


def pooled(scores: DataFrame, label: str = "label", per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(s, label, w) of ``scores`` (column ``s`` and a 0/1 label): two rows per level of the fit."""
    h = scores.groupBy("s").agg(F.count(F.lit(1)).cast("double").alias("w"),
                                F.sum(F.col(label).cast("double")).alias("t"))
    sums = with_ranges(running_sums(h, "s", ["w", "t"], per_range=per_range), "s", per_range=per_range)
    hull = sums.groupBy("_b").applyInPandas(_range_hull, CORNERS).groupBy("x").agg(
        F.first("y").alias("y"), F.max("first").alias("first"), F.max("last").alias("last"))
    c = hull.orderBy("x").toPandas()        # corners only
    c = c.iloc[corners(c["x"].to_numpy(), c["y"].to_numpy())]
    rows = []
    for a, b in zip(c.itertuples(), c.iloc[1:].itertuples()):
        mean, w = (b.y - a.y) / (b.x - a.x), b.x - a.x
        ends = [a.first] if a.first == b.last else [a.first, b.last]
        rows += [(float(s), float(mean), float(w / len(ends))) for s in ends]
    return scores.sparkSession.createDataFrame(rows, f"s double, {label} double, w double")
