"""Event log: one commit per token, refused rows, newest-first reads."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from trustframe.operators import calllog as C
from trustframe.session import scratch_path
from trustframe.sources import testdata as td
from trustframe.sources.eventlog import RefusedRows


@pytest.fixture
def path(spark):
    return scratch_path(spark, f"tests/eventlog-{uuid.uuid4().hex}")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _filled(spark, sf_dir, path):
    """Three batches by id; the newest one also has rows of an old day."""
    calls = td.api_calls(spark, sf_dir)
    top = calls.agg(F.max("id")).first()[0]
    cut = [0, top // 3, 2 * top // 3, top + 1]
    for i, (lo, hi) in enumerate(zip(cut, cut[1:])):
        assert C.append_log(calls.filter((F.col("id") >= lo) & (F.col("id") < hi)), path, f"part-{i}")
    late = calls.limit(3).withColumn("id", F.col("id") + 10 * top).withColumn(
        "timestamp", F.lit("2023-12-01 00:00:00").cast("timestamp_ntz"))
    C.append_log(late, path, "late")
    return calls.unionByName(late), C.call_log(spark, path)


def test_same_append_twice_leaves_the_rows_once(spark, sf_dir, path):
    calls = td.api_calls(spark, sf_dir)
    assert C.append_log(calls, path, "a") and not C.append_log(calls, path, "a")
    assert C.append_log(calls.limit(4), path, "b")
    log = C.call_log(spark, path)
    assert log.read().count() == calls.count() + 4
    assert log.read().select(calls.columns).exceptAll(calls).count() == 4


def test_attempts_without_a_commit_are_not_read(spark, sf_dir, path):
    calls = td.api_calls(spark, sf_dir)
    log = C.call_log(spark, path)
    assert log.read().count() == 0 and log.total("ok").first()[0] == 0
    with pytest.raises(RefusedRows, match="null in endpoint"):
        log.append(calls.withColumn("endpoint", F.when(F.col("id") % 7 > 0, F.col("endpoint"))), "a")
    assert log.read().count() == 0                  # files are there, their commit is not
    assert log.append(calls, "a") and log.read().count() == calls.count()


def test_mistyped_and_missing_columns_are_refused(spark, sf_dir, path):
    calls = td.api_calls(spark, sf_dir)
    log = C.call_log(spark, path)
    for bad in (calls.withColumn("id", F.col("id").cast("string")), calls.drop("error"),
                calls.withColumn("extra", F.lit(1))):
        with pytest.raises(RefusedRows, match="columns differ"):
            log.append(bad, "a")


def test_empty_batches_commit(spark, sf_dir, path):
    calls = td.api_calls(spark, sf_dir)
    assert C.append_log(calls.limit(0), path, "none") and not C.append_log(calls, path, "none")
    assert C.call_log(spark, path).read().count() == 0


def test_newest_rows_come_from_few_partitions(spark, sf_dir, path):
    calls, log = _filled(spark, sf_dir, path)
    every = log.partitions().count()
    for what, n in ((None, 25), ("bot_probability", 40), ("image_risk_score", 40), ("ok", 100)):
        got = C.last_n(log, n, what, calls.columns)
        want = C.last_n(calls, n, what, calls.columns)
        assert got.collect() == want.collect()
        assert "PartitionFilters: [day" in _plan(got) or "PartitionFilters: [isnotnull(day" in _plan(got) \
            or "PartitionFilters: [batch" in _plan(got)
        read = log.newest(n, what).select(F.input_file_name()).distinct().count()
        assert 0 < read < every
    late = C.last_n(log, 3).select("timestamp").distinct().collect()
    assert [r[0] for r in late] == [dt.datetime(2023, 12, 1)]


def test_more_rows_than_there_are_gives_all(spark, sf_dir, path):
    calls, log = _filled(spark, sf_dir, path)
    assert C.last_n(log, 10 * calls.count()).count() == calls.count()


def test_many_partitions_are_joined_not_named(spark, sf_dir, path, monkeypatch):
    from trustframe.sources import eventlog
    calls, log = _filled(spark, sf_dir, path)
    monkeypatch.setattr(eventlog, "NAMED_PARTITIONS", 2)
    assert log.read().count() == calls.count()
    assert C.last_n(log, 30, "ok", calls.columns).collect() == C.last_n(calls, 30, "ok", calls.columns).collect()


def test_report_of_a_log_equals_that_of_its_rows(spark, sf_dir, path):
    calls, log = _filled(spark, sf_dir, path)
    pings = td.extension_pings(spark, sf_dir)
    kept = C.ping_log(spark, path + "-pings")
    kept.append(pings, "all")
    args = (td.AS_OF_DAY, td.AS_OF_MONTH)
    assert C.stats_report(log, kept, *args).collect() == C.stats_report(calls, pings, *args).collect()


def test_pings_are_normalised_and_kept_once(spark, path):
    raw = spark.createDataFrame(
        [(1, "2024-01-01 01:00:00", "", "h1", None, "1.0"), (2, "2024-01-02 01:00:00", "e2", "h2", "1.1", None),
         (3, "2024-01-02 02:00:00", None, None, "", "")],
        "id long, timestamp string, extension_id string, hdr_extension_id string, version string, hdr_version string"
    ).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert C.append_pings(raw, path, "x") and not C.append_pings(raw, path, "x")
    got = C.ping_log(spark, path)
    rows = {r["id"]: (r["extension_id"], r["version"]) for r in got.read().collect()}
    assert rows == {1: ("h1", "1.0"), 2: ("e2", "1.1"), 3: (None, None)}
    assert C.unique_installs(got.read()).first()[0] == 2 and got.total().first()[0] == 3


def test_numbered_rows_go_on_from_the_largest_id(spark, sf_dir, path):
    calls = td.api_calls(spark, sf_dir)
    same_second = calls.withColumn("timestamp", F.lit("2024-03-01 10:00:00").cast("timestamp_ntz"))
    C.append_log(calls, path, "old")
    top = calls.agg(F.max("id")).first()[0]
    assert C.append_log(same_second.limit(50).drop("id").withColumn("id", F.lit(7).cast("long")), path, "a", number=True)
    later = same_second.limit(30).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(F.col("id") % 3))
    C.append_log(later, path, "b", number=True)
    new = [r["id"] for r in C.call_log(spark, path).read().where(F.col("id") > top).orderBy("id").collect()]
    assert new == list(range(top + 1, top + 81))
    last = C.call_log(spark, path).read().where(F.col("id") > top + 50).orderBy("id").collect()
    assert [r["timestamp"] for r in last] == sorted(r["timestamp"] for r in last)
