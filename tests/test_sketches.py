"""Value sketches: stated error, and merged days equal one pass."""

import random

import pytest
from pyspark.sql import functions as F

from trustframe.operators import sketches as K
from trustframe.operators.profilestats import describe as exact


def _rows(spark, seed):
    rnd = random.Random(seed)
    make = {0: lambda: rnd.lognormvariate(3, 2), 1: lambda: rnd.uniform(-50, 50), 2: lambda: float(rnd.randrange(4)),
            3: lambda: rnd.choice([None, float("nan"), 1e-12, -1e12, 7.0])}
    rows = [(rnd.randrange(5), *(make[k]() for k in range(4))) for _ in range(3000)]
    return spark.createDataFrame(rows, "day int, a double, b double, c double, d double")


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_stay_within_the_error(spark, seed):
    df = _rows(spark, seed)
    cols = ["a", "b", "c", "d"]
    near = {r["feature"]: r.asDict() for r in K.describe(K.sketch(df, cols)).collect()}
    clean = df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols))
    for r in exact(clean, cols).collect():
        got = near[r["feature"]]
        assert got["count"] == r["count"] and got["min"] == r["min"] and got["max"] == r["max"]
        assert got["mean"] == pytest.approx(r["mean"], rel=1e-9) and got["std"] == pytest.approx(r["std"], rel=1e-6)
        for p in ("p10", "p50", "p90"):
            assert got[p] == pytest.approx(r[p], rel=K.ERROR * 1.01, abs=1e-9), (r["feature"], p)


def test_merged_days_equal_one_pass(spark):
    df = _rows(spark, 3)
    cols = ["a", "b", "c", "d"]
    key = ["feature", "bucket", "c", "lo", "hi"]
    days = K.sketch(df, cols, ("day",))
    one, merged = K.sketch(df, cols).select(key), K.merge(days).select(key)
    assert one.exceptAll(merged).count() == 0 and merged.exceptAll(one).count() == 0
    some = K.merge(days.where("day < 2").unionByName(days.where("day >= 2")), ("day",))
    assert some.select("day", *key).exceptAll(days.select("day", *key)).count() == 0


def test_buckets_are_few_and_hold_their_values(spark):
    df = spark.range(1, 200_000).select((F.pow(F.col("id") / 200_000.0, 6) * 1e6).alias("v"))
    s = K.sketch(df, ["v"])
    assert s.count() < 1700
    off = s.where((F.abs(F.col("lo") - K.value_of(F.col("bucket"))) > K.ERROR * F.col("lo") * 1.0001)
                  | (F.abs(F.col("hi") - K.value_of(F.col("bucket"))) > K.ERROR * F.col("hi") * 1.0001))
    assert off.count() == 0


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, 0.0)], "a double, b double")
    assert K.describe(K.sketch(df.limit(0), ["a", "b"])).count() == 0
    r = K.describe(K.sketch(df, ["a", "b"])).collect()
    assert len(r) == 1 and (r[0]["feature"], r[0]["p50"], r[0]["std"]) == ("b", 0.0, None)
