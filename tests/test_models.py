"""Fitted models on a learnable label: quality bounds for every trainer."""

import pytest
from pyspark.sql import functions as F

from trustframe.operators import sampling as S
from trustframe.plans import training as T
from trustframe.plans.importance import permutation_importance
from trustframe.session import materialize
from trustframe.sources import testdata as td

AUC = 0.9      # the label follows from two features; every trainer must find them


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    a = td.accounts(spark, sf_dir)
    label = (F.col("tweet_count") + 20 * F.col("has_url") > 50).cast("int")
    data = materialize(T.training_frame(a.withColumn("label", label)))
    return S.stratified_split(data)


def _score(model, df):
    return model.transform(df).withColumn("score", T.p_bot())


def test_baseline_forest(parts):
    _, pred = T.forest_baseline(*parts, trees=30)
    ev = T.evaluate(pred, cut=T.DEFAULT_CUT)
    assert ev["roc_auc"] >= AUC and ev["threshold"] == 0.5


def test_tuned_and_wide_search(parts):
    train, test = parts
    cv = T.tuned_forest(train, n_iter=1, trees=20)
    assert T.evaluate(_score(cv.bestModel, test))["roc_auc"] >= AUC
    assert set(T.best_params(cv)) == set(T.TUNED_GRID)
    wide = T.wide_forest(train, n_iter=1)
    assert T.evaluate(wide.transform(test), cut=T.DEFAULT_CUT)["roc_auc"] >= AUC


def test_boosted_trees(parts):
    train, test = parts
    assert T.evaluate(_score(T.gbt(train, {"maxIter": 15}), test))["roc_auc"] >= AUC


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration(parts, method):
    train, test = parts
    ev = T.evaluate(T.predict_calibrated(T.calibrated_forest(train, method, trees=20), test, method))
    assert ev["roc_auc"] >= AUC and ev["brier"] <= 0.15


def test_importance_finds_the_two_features(parts, spark):
    train, _ = parts
    model = T.calibrated_blocks(train, trees=30)
    rows = permutation_importance(model, train, repeats=2).collect()
    assert len(rows) == len(T.FEATURES)
    mean = {r["feature"]: r["importance_mean"] for r in rows}
    tweets = [mean[c] for c in mean if "tweet" in c]
    assert max(tweets) > 0 and max(mean.values()) in [*tweets, mean["has_url"]]
    assert mean["verified"] <= max(tweets)


def test_training_tables_take_a_task_per_core_at_most():
    assert [T.fit_partitions(n, 12) for n in (0, 1, 2_000, 2_001, 120_000, 4_320_000)] == [1, 1, 1, 2, 12, 22]


def test_scoring_runs_in_all_cores_on_accounts_derived_once(spark, sf_dir):
    """Trees cost far more than a row's bytes tell, and a sample and its counts read the accounts many times."""
    acc, read = td.scored_accounts(spark, sf_dir), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    members, summary = T.train_production(acc.mapInArrow(seen, acc.schema), n_iter=1, folds=2, trees=4)
    assert read.value == acc.count() == summary["n_samples"]
    out = T.score_accounts(acc, members, summary["optimal_threshold"])
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_members_score_a_row_in_one_pass(parts):
    """Each pass sends the rows to Python and bins them anew."""
    train, test = parts
    members = T.calibrated_forest(train, "sigmoid", trees=4)
    out = T.predict_calibrated(members, test)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for i, (base, _) in enumerate(members):
        own = {r["id"]: r["s"] for r in base.transform(test).select("id", T.p_bot().alias("s")).collect()}
        assert {r["id"]: r["s"] for r in out.select("id", F.col(f"_s{i}").alias("s")).collect()} == own


def test_search_and_calibration_share_their_folds(spark, sf_dir, monkeypatch):
    made, fold_column = [], S.fold_column
    monkeypatch.setattr(S, "fold_column", lambda df, k, **kw: made.append(k) or fold_column(df, k, **kw))
    acc = td.accounts(spark, sf_dir)
    _, summary = T.train_production(acc, n_iter=1, trees=4)
    assert made == [T.CAL_FOLDS]
    # other folds for the search than for the calibration: each its own
    _, other = T.train_production(acc, n_iter=1, folds=2, trees=4)
    assert made[1:] == [2, T.CAL_FOLDS] and other["test_rows"] == summary["test_rows"]


def test_accounts_are_derived_once_for_training_and_scoring(spark, sf_dir, monkeypatch):
    from trustframe.plans import q_models as Q
    read, accounts, train = spark.sparkContext.accumulator(0), td.accounts, T.train_production

    def counted(*a):
        out = accounts(*a)

        def seen(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch
        return out.mapInArrow(seen, out.schema)

    monkeypatch.setattr(td, "accounts", counted)
    monkeypatch.setattr(T, "train_production", lambda acc: train(acc, n_iter=1, trees=4))
    monkeypatch.setattr(Q, "_FITTED", {})
    rows = Q.score_accounts(spark, sf_dir).collect()
    n = accounts(spark, sf_dir).count()
    assert read.value == n and 0 < len(rows) <= n
