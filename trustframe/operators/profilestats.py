"""Exploratory statistics: label counts and a transposed ``describe``.

Quantiles are exact (linear interpolation between the two neighbouring
order statistics) without collecting a feature's values into one task: the
values are reduced to a (feature, value, count) histogram, ranked with the
parallel prefix sum, and the two neighbours of each target rank are picked
with a join against a small (feature x quantile) target table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from .prefix import running_sums

DESCRIBE_PROBS = (0.1, 0.5, 0.9)   # fixed value: percentiles of the describe table


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Value counts of the label including NULL, plus the row count."""
    return (df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("count"))
            # the window runs over the few label rows only
            .withColumn("n_rows", F.sum("count").over(Window.partitionBy())))


def long_form(df: DataFrame, cols, id_cols=()) -> DataFrame:
    """(feature, value) rows; one Expand per input row, no shuffle."""
    return df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(id_cols), list(cols), "feature", "value")


def histogram(long: DataFrame, group: str = "feature", value: str = "value") -> DataFrame:
    """(group, value, c) without NULL and NaN, written once: several steps read it."""
    return materialize(long.filter(F.col(value).isNotNull() & ~F.isnan(value))
                       .groupBy(group, value).agg(F.count(F.lit(1)).alias("c")))


def exact_quantiles(long: DataFrame, probs=DESCRIBE_PROBS, group: str = "feature",
                    value: str = "value") -> DataFrame:
    """(group, q, quantile) with linear interpolation, NULLs skipped."""
    return histogram_quantiles(histogram(long, group, value), probs, group, value)


def histogram_quantiles(h: DataFrame, probs=DESCRIBE_PROBS, group: str = "feature",
                        value: str = "value") -> DataFrame:
    cum = running_sums(h, value, ["c"], groups=(group,))
    n = h.groupBy(group).agg(F.sum("c").alias("n"))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("q")
    targets = n.select(group, "n", qs).withColumn("pos", F.col("q") * (F.col("n") - 1))
    targets = targets.withColumns({"lo": F.floor("pos"), "hi": F.ceil("pos")})
    start = F.col("cum_c") - F.col("c")

    def at(rank: str):
        # value whose rank range [cum_c - c, cum_c) holds the target rank
        return F.max(F.when((start <= F.col(rank)) & (F.col(rank) < F.col("cum_c")), F.col(value)))

    # one join against the (#groups x #probs) target table, broadcast by size;
    # both neighbours are picked in the same aggregate
    j = cum.join(F.broadcast(targets), on=[group])
    j = j.filter(((start <= F.col("lo")) & (F.col("lo") < F.col("cum_c")))
                 | ((start <= F.col("hi")) & (F.col("hi") < F.col("cum_c"))))
    r = j.groupBy(group, "q", "pos", "lo").agg(at("lo").alias("v_lo"), at("hi").alias("v_hi"))
    frac = F.col("pos") - F.col("lo")
    return r.select(group, "q", (F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * frac).alias("quantile"))


def describe(df: DataFrame, cols, probs=DESCRIBE_PROBS) -> DataFrame:
    """Transposed describe: count, mean, sample sd, min, percentiles, max per column."""
    h = histogram(long_form(df, cols))      # the only pass over df
    n = F.sum("c")
    moments = h.groupBy("feature").agg(n.alias("count"), (F.sum(F.col("value") * F.col("c")) / n).alias("mean"),
                                       F.min("value").alias("min"), F.max("value").alias("max"))
    # squares around the mean, from the histogram: one row per feature is joined
    around = h.join(F.broadcast(moments.select("feature", "mean")), "feature")
    square = (around.groupBy("feature").agg(F.sum((F.col("value") - F.col("mean")) ** 2 * F.col("c")).alias("ss")))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("ss") / (F.col("count") - 1))).alias("std")
    basic = moments.join(square, "feature").select("feature", "count", "mean", std, "min", "max")
    # a column of nulls only still has its line
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    basic = names.join(basic, "feature", "left").na.fill(0, ["count"])
    q = histogram_quantiles(h, probs)
    wide = q.groupBy("feature").pivot("q", [float(p) for p in probs]).agg(F.first("quantile"))
    wide = wide.select("feature", *[F.col(f"`{float(p)}`").alias(f"p{int(round(p * 100))}") for p in probs])
    return basic.join(wide, "feature", "left")
