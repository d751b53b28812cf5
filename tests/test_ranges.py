"""Sized prefix ranges, isotonic pooling on the executors, committed run versions."""

import random
import uuid

import numpy as np
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from trustframe.operators import isotonic as I
from trustframe.operators import prefix as P
from trustframe.session import scratch_path
from trustframe.sources import commits
from trustframe.sources import tables as TB


def _points(spark, n, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(g, float(v), rnd.randrange(5)) for g in ("a", "b") for v in
                                  rnd.sample(range(10 * n), n if g == "a" else n // 10)],
                                 "g string, v double, c int").cache()


@pytest.mark.parametrize("per_range", [7, 100, 10**6])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_for_any_range_size(spark, per_range, descending):
    df = _points(spark, 400)
    got = {(r["g"], r["v"]): r["cum_c"] for r in P.running_sums(
        df, "v", ["c"], groups=("g",), descending=descending, per_range=per_range).collect()}
    want, total = {}, {"a": 0, "b": 0}
    for r in sorted(df.collect(), key=lambda r: r["v"], reverse=descending):
        total[r["g"]] += r["c"]
        want[r["g"], r["v"]] = total[r["g"]]
    assert got == want


def test_ranges_stay_bounded_as_rows_grow(spark):
    for n in (2_000, 8_000, 32_000):
        df = spark.range(n).select((F.col("id") * 7919 % 1000003).cast("double").alias("v"), F.lit(1).alias("c"))
        sizes = [r["count"] for r in P.with_ranges(df, "v", per_range=500).groupBy("_b").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 600 and len(sizes) >= n // 600


def _fit(rows):
    return IsotonicRegression(featuresCol="s", labelCol="label", weightCol="w", predictionCol="cal").fit(rows)


@pytest.mark.parametrize("kind", ["noise", "ties", "rising", "falling", "two"])
@pytest.mark.parametrize("per_range", [20, 10**6])
def test_isotonic_fit_equals_the_estimator_on_all_rows(spark, kind, per_range):
    rnd = random.Random(kind)
    n = 2 if kind == "two" else 600
    rows = []
    for i in range(n):
        s = round(rnd.random(), 1 if kind == "ties" else 6)
        label = {"rising": float(s > 0.4), "falling": float(s < 0.4)}.get(kind, float(rnd.random() < s))
        rows.append((s, label))
    df = spark.createDataFrame(rows, "s double, label double")
    grid = spark.createDataFrame([(i / 200,) for i in range(-5, 206)], "s double").union(df.select("s"))
    whole = df.groupBy("s").agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("w"))
    a = _fit(whole).transform(grid).toPandas()["cal"].to_numpy()
    b = _fit(I.pooled(df, per_range=per_range)).transform(grid).toPandas()["cal"].to_numpy()
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_pooling_sends_levels_not_scores_to_the_driver(spark):
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("s"), (F.col("id") % 3 == 0).cast("double").alias("label"))
    assert I.pooled(df, per_range=1000).count() < 50


def test_hull_corners():
    x = np.array([0, 1, 2, 3, 4.0])
    assert I.corners(x, np.array([0, 0, 0, 1, 2.0])).tolist() == [0, 2, 4]
    assert I.corners(x, np.array([0, 1, 1, 1, 1.0])).tolist() == [0, 4]
    assert I.corners(x[:1], x[:1]).tolist() == [0]


def test_a_broken_save_leaves_the_old_run(spark, monkeypatch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    model = Pipeline(stages=[VectorAssembler(inputCols=["a"], outputCol="x")]).fit(
        spark.createDataFrame([(1.0,)], "a double"))
    run = scratch_path(spark, f"tests/run-{uuid.uuid4().hex}")
    with pytest.raises(FileNotFoundError):
        TB.load_run(run, spark)
    assert TB.save_run(model, {"optimal_threshold": 0.1}, run, spark) == 1

    def broken(*_):
        raise OSError("lost")
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", broken)
        with pytest.raises(OSError):
            TB.save_run(model, {"optimal_threshold": 0.2}, run, spark)
    assert TB.versions(spark, run) == [1] and TB.load_run(run, spark)[2] == 0.1
    assert TB.save_run(model, {"optimal_threshold": 0.3}, run, spark) == 2
    assert TB.load_run(run, spark)[2] == 0.3 and TB.load_run(run, spark, version=1)[2] == 0.1
    with pytest.raises(FileNotFoundError):
        TB.load_run(run, spark, version=7)


def test_publish_has_one_winner(spark):
    path = scratch_path(spark, f"tests/commit-{uuid.uuid4().hex}") + "/_commits/x"
    assert commits.publish(spark, path, "first") and not commits.publish(spark, path, "second")
    assert spark.read.text(path).first()[0] == "first"
    assert commits.names(spark, path.rsplit("/", 1)[0]) == ["x"]
