"""Golden edge cases (literal tables, FIXTURES.md part C) and brute-force checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustframe.functions.text import account_age_days
from trustframe.operators import metrics as M
from trustframe.operators import sampling as S
from trustframe.operators import scoring as SC
from trustframe.operators import scraped as X
from trustframe.operators.features import build_features
from trustframe.operators.flatten import flatten_accounts
from trustframe.operators.prefix import running_sums
from trustframe.schemas import FEATURES
from trustframe.sources.raw_json import rejected_raw, unwrap_accounts


def _np_features(row):
    """Brute-force twin of the feature rules in NumPy (float semantics)."""
    with np.errstate(all="ignore"):
        f = {k: np.float64(np.nan if v is None else v) for k, v in row.items()}
        age = f["account_age_days"] if not f["account_age_days"] <= 0 else 1.0

        def sr(a, b):
            return a / (1.0 if b == 0 else b)
        r = {
            "followers_following_ratio": sr(f["followers_count"], f["following_count"]),
            "tweets_per_day": sr(f["tweet_count"], age),
            "favourites_per_day": sr(f["favourites_count"], age),
            "ff_log_ratio": sr(np.log1p(f["followers_count"]), np.log1p(f["following_count"])),
            "listed_per_1k_followers": 1000.0 * sr(f["listed_count"], f["followers_count"] + 1),
        }
        out = {}
        for k, v in r.items():
            v = 0.0 if (np.isnan(v) or np.isinf(v)) else v
            out[k] = float(min(max(v, 0.0), 1e6))
    return out


EDGE_ROWS = [
    dict(followers_count=0.0, following_count=0.0, tweet_count=0.0, listed_count=0.0,
         favourites_count=0.0, account_age_days=0.0),
    dict(followers_count=None, following_count=3.0, tweet_count=5.0, listed_count=1.0,
         favourites_count=2.0, account_age_days=-3.0),
    dict(followers_count=-5.0, following_count=-1.0, tweet_count=float("nan"), listed_count=1.0,
         favourites_count=2.0, account_age_days=29.0),
    dict(followers_count=5e12, following_count=1.0, tweet_count=1e13, listed_count=1.0,
         favourites_count=1e9, account_age_days=1.0),
    dict(followers_count=19.0, following_count=20.0, tweet_count=100.0, listed_count=2.0,
         favourites_count=7.0, account_age_days=366.0),
]


def test_feature_edges_match_numpy(spark):
    rows = [dict(id=i, **r) for i, r in enumerate(EDGE_ROWS)]
    df = spark.createDataFrame(rows, "id long, followers_count double, following_count double, tweet_count double, "
                                     "listed_count double, favourites_count double, account_age_days double")
    got = {r["id"]: r for r in build_features(df, keep=("id",)).collect()}
    assert list(build_features(df).columns) == list(FEATURES) and len(FEATURES) == 25
    for i, raw in enumerate(EDGE_ROWS):
        exp = _np_features(raw)
        for k, v in exp.items():
            assert got[i][k] == pytest.approx(v, rel=1e-12, abs=1e-12), (i, k)


def test_missing_base_columns_default_to_zero(spark):
    df = spark.createDataFrame([(1, 10.0)], "id long, followers_count double")
    r = build_features(df, keep=("id",)).first()
    assert r["following_count"] == 0.0 and r["verified"] == 0
    assert r["followers_following_ratio"] == 10.0


@pytest.mark.parametrize("age,followers,photo,desc,ver,expected", [
    (0, 0, 0, 0, 0, 0.35), (29, 19, 0, 0, 0, 0.35), (29, 20, 0, 0, 0, 0.5), (30, 0, 0, 0, 0, 0.5),
    (365, 100, 0, 0, 0, 0.5), (366, 100, 0, 0, 0, 0.6), (730, 0, 0, 0, 0, 0.6), (731, 0, 1, 1, 1, 0.9),
    (None, None, None, None, None, 0.35),
])
def test_heuristic_edges(spark, age, followers, photo, desc, ver, expected):
    num = (lambda v: None if v is None else float(v))
    df = spark.createDataFrame([(num(age), num(followers), photo, desc, ver)],
                               "account_age_days double, followers_count double, has_profile_image int, "
                               "has_description int, verified int")
    got = df.select(SC.heuristic_score().alias("h")).first()["h"]
    assert got == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("p,th,level,is_bot", [
    (0.2999, 0.30, "Low", False), (0.30, 0.30, "Medium", True), (0.5999, 0.30, "Medium", True),
    (0.60, 0.30, "High", True), (0.65, 0.70, "High", False), (0.69, 0.70, "High", False),
])
def test_risk_level_edges(spark, p, th, level, is_bot):
    r = spark.range(1).select(SC.risk_level(F.lit(p), th).alias("l"), SC.is_bot(F.lit(p), th).alias("b")).first()
    assert (r["l"], r["b"]) == (level, is_bot)


def test_trust_and_combined_with_optional_image(spark):
    df = spark.createDataFrame([(0.2, 0.7, None), (0.2, 0.7, 0.0), (0.2, 0.7, 1.0)],
                               "p double, h double, img double")
    rows = df.select(SC.trust_score_raw("p", "h", "img").alias("t"),
                     SC.combined_probability_raw("p", "img").alias("c"),
                     SC.ensemble_struct("p", "h", "img").alias("e")).collect()
    assert rows[0]["t"] == pytest.approx(0.6 * 0.8 + 0.4 * 0.7)
    assert rows[0]["c"] == 0.2 and rows[0]["e"]["weights"]["image_risk"] == 0.0
    assert rows[1]["c"] == pytest.approx(0.16) and rows[1]["e"]["weights"]["image_risk"] == 0.15
    assert rows[2]["t"] == pytest.approx(0.6 * 0.8 + 0.4 * 0.7 - 0.15)
    assert rows[2]["e"]["trust_level"] == "Moderate Trust"


@pytest.mark.parametrize("text,expected", [
    ("8.7K", 8700), ("2M", 2000000), ("1,234", 1234), ("1.2.3", 1), ("12 k", 12000),
    ("", 0), ("abc", 0), ("3.4B", 0), (None, 0),
])
def test_parse_count(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(X.parse_count("t").alias("n")).first()["n"] == expected


@pytest.mark.parametrize("url,is_profile,handle", [
    ("https://x.example/name", True, "name"), ("https://x.example/name/", True, "name"),
    ("https://x.example/Home", False, "Home"), ("https://x.example/name/status/1", False, "name"),
    ("https://x.example/", False, ""), (None, False, ""),
])
def test_profile_urls(spark, url, is_profile, handle):
    df = spark.createDataFrame([(url,)], "u string")
    r = df.select(F.coalesce(X.is_profile_url("u"), F.lit(False)).alias("p"), X.profile_handle("u").alias("h")).first()
    assert (r["p"], r["h"]) == (is_profile, handle)


@pytest.mark.parametrize("text,age,display", [
    ("Joined June 2018", None, "June 2018 ("), ("joined Jan 2020", None, "Jan 2020 ("),
    (None, 365, ""), ("Joined Foo 2018", 365, ""),
])
def test_join_age(spark, text, age, display):
    df = spark.createDataFrame([(text,)], "t string")
    a, d = X.join_age("t", "2024-01-30 12:00:00")
    r = df.select(a.alias("a"), d.alias("d")).first()
    if age is not None:
        assert r["a"] == age
    assert r["d"].startswith(display)


def test_created_at_formats(spark):
    rows = [("Wed Oct 10 20:19:24 +0000 2018",), ("2020-01-16 02:02:55+00:00",), ("2020-01-16T02:02:55",),
            ("",), ("garbage",), ("2030-01-01T00:00:00",)]
    df = spark.createDataFrame(rows, "s string")
    got = [r["a"] for r in df.select(account_age_days("s", "2024-01-30 12:00:00").alias("a")).collect()]
    assert got[0] == 1937 and got[1] == got[2] == 1475
    assert got[3:] == [0, 0, 0]


def test_raw_json_shapes(spark):
    docs = ['{"id": 1, "followers_count": 5, "verified": "False", "description": "  "}',
            '[2, {"id": 2, "tweet_count": 7, "favorite_count": 3.9, "default_profile_image": null}]',
            '[{"id": 3, "profile": {"statuses_count": 9, "default_profile": false}}]',
            '[1, 2]', '"junk"']
    raw = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "idx long, s string") \
        .select("idx", F.try_parse_json("s").alias("v"))
    u = unwrap_accounts(raw)
    flat = {r["id"]: r for r in flatten_accounts(u, "2024-01-30 12:00:00").collect()}
    assert set(flat) == {"1", "2", "3"}
    assert flat["1"]["verified"] == 1 and flat["1"]["has_description"] == 0
    assert flat["1"]["has_profile_image"] == 0          # key absent -> default avatar
    assert flat["2"]["has_profile_image"] == 1          # explicit null -> custom photo
    assert flat["2"]["tweet_count"] == 7 and flat["2"]["favourites_count"] == 3.0
    assert flat["3"]["tweet_count"] == 9 and flat["3"]["default_profile"] == 0
    assert rejected_raw(u).count() == 2


def _sk_like_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


@pytest.mark.parametrize("y,s", [
    ([0, 1, 0, 1, 1, 0], [0.1, 0.9, 0.4, 0.4, 0.8, 0.2]),     # ties
    ([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]),                     # perfect
    ([1, 0, 1, 0, 1], [0.5, 0.5, 0.5, 0.5, 0.5]),             # all equal
])
def test_auc_matches_brute_force(spark, y, s):
    ls = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    auc = M.roc_auc(M.pr_curve(ls, n_buckets=3)).first()["roc_auc"]
    assert auc == pytest.approx(_sk_like_auc(y, s))


def test_auc_one_class_is_null(spark):
    ls = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert M.roc_auc(M.pr_curve(ls)).first()["roc_auc"] is None


def test_running_sums_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 1000, 500)
    keys = np.unique(vals)
    df = spark.createDataFrame([(int(k), int((vals == k).sum())) for k in keys], "k long, c long")
    got = {r["k"]: r["cum_c"] for r in running_sums(df, "k", ["c"], n_buckets=8).collect()}
    acc = 0
    for k in keys:
        acc += int((vals == k).sum())
        assert got[int(k)] == acc
    desc = {r["k"]: r["cum_c"] for r in running_sums(df, "k", ["c"], descending=True, n_buckets=8).collect()}
    assert desc[int(keys[0])] == 500 and desc[int(keys[-1])] == int((vals == keys[-1]).sum())


def test_capped_sample_exact_counts(spark):
    df = spark.range(0, 5000).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    s = S.capped_sample(df, {1: 300, 0: 10_000})
    counts = {r["label"]: r["n"] for r in s.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 300, 0: 4000}
    again = S.capped_sample(df, {1: 300, 0: 10_000})
    assert s.exceptAll(again).count() == 0


def test_log_window_boundary_day(spark):
    from trustframe.operators.calllog import daily_calls
    rows = [(1, "2024-01-10 23:59:59"), (2, "2024-01-11 00:00:00"), (3, "2024-01-11 00:00:01")]
    df = spark.createDataFrame(rows, "id long, ts string").select(
        "id", F.to_timestamp_ntz("ts").alias("timestamp"), F.lit(0).alias("error"))
    out = {r["day"]: r["count"] for r in daily_calls(df, "2024-02-10 12:00:00").collect()}
    assert out == {"2024-01-11": 2}


def test_text_presence_python_strip(spark):
    from trustframe.functions.text import text_present
    df = spark.createDataFrame([(None,), ("",), (" \n\t ",), (" x ",)], "t string")
    assert [r[0] for r in df.select(text_present("t")).collect()] == [0, 0, 0, 1]
    assert math.isclose(1.0, 1.0)


def test_calibration_plan_rule(spark, sf_dir):
    from trustframe.plans import training as T
    from trustframe.sources import testdata as td
    d = T.training_frame(td.accounts(spark, sf_dir))
    assert T.calibration_plan(d) == ("isotonic", 3)
    small = d.orderBy("id").limit(40)
    method, folds = T.calibration_plan(small)
    assert method == "sigmoid" and folds >= 2
    assert T.calibration_plan(d.filter("label = 1")) == (None, 0)


def test_cluster_conf_sizes_partitions():
    from trustframe.session import cluster_conf
    c = cluster_conf(10 << 40)
    assert int(c["spark.sql.shuffle.partitions"]) == (10 << 40) // (256 << 20) + 1
    assert int(cluster_conf(1 << 20)["spark.sql.shuffle.partitions"]) == 8000


def test_stratified_split_exact_and_disjoint(spark):
    df = spark.range(0, 2000).withColumn("label", (F.col("id") % 4 == 0).cast("int"))
    train, test = S.stratified_split(df)
    t = {r["label"]: r["n"] for r in test.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert t == {1: 100, 0: 300}
    assert train.count() + test.count() == 2000
    assert train.join(test, "id").count() == 0


def test_equal_sample_takes_min_of_cap_and_bots(spark):
    df = spark.range(0, 3000).withColumn("label", (F.col("id") % 10 == 0).cast("int"))
    s = S.equal_sample(df)
    counts = {r["label"]: r["n"] for r in s.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 300, 0: 300}


# ---- round 2: one golden per corrected rule ---------------------------------------

def test_no_break_space_is_blank(spark):
    from trustframe.functions.text import strip_ws, text_present
    rows = [(" ",), (" 　",), ("\x1c\x85",), (" x ",), ("​",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(text_present("t")).collect()] == [int(bool(t.strip())) for t, in rows]
    assert [r[0] for r in df.select(strip_ws("t")).collect()] == [t.strip() for t, in rows]


def test_year_or_month_alone_is_no_date(spark):
    df = spark.createDataFrame([("2020",), ("2020-01",), ("2020-01-01",)], "s string")
    got = [r["a"] for r in df.select(account_age_days("s", "2024-01-30 12:00:00").alias("a")).collect()]
    assert got == [0, 0, 1490]


def test_average_precision_needs_both_classes(spark):
    for rows in ([(1, 0.2), (1, 0.4)], [(0, 0.2)]):
        ls = spark.createDataFrame(rows, "label int, score double")
        assert M.average_precision(M.pr_curve(ls)).first()["average_precision"] is None


def test_exact_median_of_an_even_count(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 2.0, None), (3, None, None), (4, float("nan"), None)],
                               "id int, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in S.impute_median(df, ["x", "y"]).collect()}
    assert got == {1: (1.0, None), 2: (2.0, None), 3: (1.5, None), 4: (1.5, None)}


def test_fold_counts_and_stratified_folds(spark):
    assert S.n_folds(1, 100) == 5 and S.n_folds(3, 100) == 3 and S.n_folds(9, 100) == 5 and S.n_folds(1, 2) == 2
    df = spark.range(0, 1003).withColumn("label", (F.col("id") % 7 == 0).cast("int"))
    n = {(r["label"], r["fold"]): r["n"] for r in S.fold_column(df, 3).groupBy("label", "fold")
         .agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        sizes = [n[label, f] for f in range(3)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == df.filter(F.col("label") == label).count()


def test_split_with_null_labels_and_repeated_ids(spark):
    df = spark.createDataFrame([(i // 2, i // 2 % 3 == 0 and 1 or 0) for i in range(400)] + [(900, None)],
                               "id long, label int")
    train, test = S.stratified_split(df)
    assert train.count() + test.count() == 401
    assert train.join(test, "id").count() == 0
    assert train.filter("label IS NULL").count() == 1


def test_wide_ranges_leave_out_the_upper_end():
    from pyspark.ml.classification import RandomForestClassifier
    from trustframe.plans import training as T
    rf = RandomForestClassifier()
    for c in T.wide_candidates(400, rf):
        assert 200 <= c[rf.numTrees] < 600 and 4 <= c[rf.maxDepth] < 20
        assert 1 <= c[rf.minInstancesPerNode] < 10
    assert T._forest_pipeline(5)[1].getMaxDepth() == 30


def test_recent_calls_report_shows_dash_for_null(spark):
    from trustframe.operators.calllog import recent_calls, recent_calls_report
    df = spark.createDataFrame([(1, "a", None, 0.5, None, None, 0), (2, "b", 0.25, None, "Low", 12.4, 1)],
                               "id long, endpoint string, bot_probability double, image_risk_score double, "
                               "risk_level string, response_time_ms double, error int") \
        .withColumn("timestamp", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    r = recent_calls(df)
    assert len(r.columns) == 7
    got = recent_calls_report(r).collect()
    assert [x["Bot Prob"] for x in got] == ["25.0%", "—"] and got[1]["Response Time"] == "—"


def test_slow_hours_finds_hours_above_the_target(spark):
    from trustframe.operators.calllog import rt_trend, slow_hours
    rows = [("2024-01-30 01:10:00", 100.0, 0), ("2024-01-30 01:50:00", 400.0, 0), ("2024-01-30 02:00:00", 200.0, 0),
            ("2024-01-30 03:00:00", 900.0, 1)]
    df = spark.createDataFrame(rows, "ts string, response_time_ms double, error int").select(
        F.to_timestamp_ntz("ts").alias("timestamp"), "response_time_ms", "error")
    got = slow_hours(rt_trend(df, "2024-01-30 12:00:00")).collect()
    assert [(r["hour"], r["avg_ms"]) for r in got] == [("2024-01-30T01:00:00", 250.0)]


def test_log_ids_grow_with_time_and_differ_per_call(spark):
    from trustframe.operators.calllog import call_log_rows
    df = spark.createDataFrame([(7, "2024-01-01 00:00:00"), (7, "2024-01-01 00:00:05"), (3, "2024-01-02 00:00:00")],
                               "id long, ts string").select("id", F.to_timestamp("ts").alias("timestamp"),
                                                            F.lit(1.0).alias("response_time_ms"))
    ids = [r["id"] for r in call_log_rows(df).orderBy("timestamp").collect()]
    assert ids == sorted(set(ids)) and len(ids) == 3


def test_scoring_result_is_flat(spark):
    from trustframe.plans import training as T
    a = spark.createDataFrame([(1, 0.5, None), (2, 0.2, 0.5)], "id int, p double, img double")
    base = {c: F.lit(400.0) for c in ("followers_count", "account_age_days")}
    flags = {c: F.lit(1) for c in ("has_profile_image", "has_description", "verified")}
    r = T.scored_result(a.withColumns({**base, **flags}), "p", "img", 0.3).orderBy("id").collect()
    assert r[0]["user"].asDict() == {"is_bot": True, "bot_probability": 0.5, "risk_level": "Medium",
                                     "threshold_used": 0.3, "combined_bot_probability": 0.5}
    assert r[1]["user"]["combined_bot_probability"] == pytest.approx(0.26)
