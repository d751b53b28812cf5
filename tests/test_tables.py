"""Table scans keep their schemas; trainers bound and choose their inputs."""

import uuid

import pytest
from pyspark.sql import functions as F

from trustframe.operators import sampling as S
from trustframe.operators.labels import drop_target, require_columns
from trustframe.plans import training as T
from trustframe.schemas import ACCOUNTS_SCHEMA, FEATURES
from trustframe.session import scratch_path
from trustframe.sources import tables as TB
from trustframe.sources import testdata as td


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"tests/tables-{uuid.uuid4().hex}")


def test_parquet_accounts_take_the_schema(spark, path):
    (spark.createDataFrame([(7, 3, "x", 1.0), (8, 4, "5", None)], "id long, followers_count int, verified string, extra double")
     .write.parquet(path))
    a = TB.read_accounts(spark, path, "parquet")
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in ACCOUNTS_SCHEMA]
    rows = [(r["id"], r["followers_count"], r["verified"], r["label"]) for r in a.orderBy("id").collect()]
    assert rows == [("7", 3.0, None, None), ("8", 4.0, 5, None)]      # "x" is no flag; label is absent
    assert a._jdf.queryExecution().executedPlan().toString().count("extra") == 0


def test_parquet_labels_and_split(spark, path):
    spark.createDataFrame([(1, "bot")], "id long, label string").write.parquet(path + "/l")
    assert [tuple(r) for r in TB.read_labels(spark, path + "/l", "parquet").collect()] == [("1", "bot")]
    with pytest.raises(ValueError, match="split"):
        require_columns(TB.read_labels(spark, path + "/l", "parquet"), ["id", "split"])
    assert TB.maybe_split(spark, path + "/l", "parquet") is None
    spark.createDataFrame([(1, "train", 2)], "id long, split string, n int").write.parquet(path + "/s")
    assert [tuple(r) for r in TB.maybe_split(spark, path + "/s", "parquet").collect()] == [("1", "train")]


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError, match=r"missing columns: \['a', 'label'\]"):
        require_columns(df, ["id", "label", "a"])
    assert require_columns(df, ["id"]) is df


def test_target_and_id_are_no_inputs(spark):
    df = spark.createDataFrame([(1, 0, 2.0)], "id int, label int, x double")
    assert drop_target(df).columns == ["x"] and drop_target(df.select("x")).columns == ["x"]


def test_boosting_fits_a_stratified_subsample(spark, sf_dir, monkeypatch):
    data = T.training_frame(td.accounts(spark, sf_dir))
    n = data.count()
    seen = {}
    packed = T.packed

    def spy(df):
        seen["rows"] = df.count()
        seen["bots"] = df.filter("label = 1").count()
        return packed(df)
    monkeypatch.setattr(T, "packed", spy)
    model = T.gbt(data, {"maxIter": 1}, rows=n // 2)
    share = data.filter("label = 1").count() / n
    assert abs(seen["rows"] - n // 2) <= 1 and abs(seen["bots"] - share * (n // 2)) <= 1
    assert model.stages[0].getInputCols() == list(FEATURES)
    assert data.filter(F.col("label").isNull()).count() == 0


def test_boosting_fits_all_rows(spark, monkeypatch):
    """No row is left out unless the caller bounds the fit, however many there are."""
    n = S.SUBSAMPLE_ROWS + 500
    data = spark.range(n).select("id", (F.col("id") % 4 == 0).cast("double").alias("label"),
                                 (F.col("id") % 7).cast("double").alias("x"))
    seen = []
    packed = T.packed
    monkeypatch.setattr(T, "packed", lambda df: seen.append(df.count()) or packed(df))
    model = T.gbt(data, {"maxIter": 1, "maxDepth": 1, "subsamplingRate": 1.0})
    root = model.stages[-1].trees[0]._call_java("rootNode").impurityStats()
    assert seen == [n] and root.rawCount() == n
