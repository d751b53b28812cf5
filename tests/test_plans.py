"""Plan-shape checks: pushdown, column pruning, no repeated top-k scans."""

from trustframe.plans.registry import queries

Q = queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hourly_window_filter_reaches_scan(spark, sf_dir):
    p = _plan(Q["hourly_calls"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p


def test_accounts_scan_reads_two_lineitem_columns(spark, sf_dir):
    p = _plan(Q["features_all"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_kpi_row_reads_each_top_k_once(spark, sf_dir):
    df = Q["stats_summary"](spark, sf_dir)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert sum(1 for line in text.splitlines() if line.startswith("(") and "TakeOrderedAndProject" in line) == 2


def _count(plan: str, what: str) -> int:
    return sum(what in line for line in plan.splitlines())


def test_log_windows_prune_a_day_partitioned_log(spark, sf_dir):
    import uuid

    from trustframe.operators import calllog as C
    from trustframe.session import scratch_path
    from trustframe.sources import testdata as td
    path = scratch_path(spark, f"tests/log-{uuid.uuid4().hex}")
    C.append_log(td.api_calls(spark, sf_dir), path)
    log = spark.read.parquet(path)
    for df in (C.hourly_calls(log, td.AS_OF_DAY), C.daily_calls(log, td.AS_OF_DAY), C.rt_trend(log, td.AS_OF_DAY),
               C.calls_today(log, td.AS_OF_DAY)):
        assert "PartitionFilters: [isnotnull(day" in _plan(df)
    a = C.hourly_calls(td.api_calls(spark, sf_dir), td.AS_OF_DAY).collect()
    assert a == C.hourly_calls(log, td.AS_OF_DAY).collect()


def test_samples_and_splits_are_filters(spark, sf_dir):
    from trustframe.operators import sampling as S
    calls = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS id", "CAST(c_acctbal < 2000 AS INT) AS label", "c_name")
    for df in (S.balanced_sample(calls, caps={1: 5, 0: 10}), *S.stratified_split(calls)):
        p = _plan(df)
        assert "Exchange" not in p and "Join" not in p and _count(p, "FileScan") == 1


def test_scoring_has_no_self_join(spark, sf_dir):
    from trustframe.plans import training as T
    from trustframe.sources import testdata as td
    acc = td.scored_accounts(spark, sf_dir)
    members = T.calibrated_forest(T.training_frame(acc), folds=2, trees=2)
    df = T.score_accounts(acc, members, 0.5)
    n = sum("Join" in x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert n == sum("Join" in x for x in acc._jdf.queryExecution().optimizedPlan().toString().splitlines())
