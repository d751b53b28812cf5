"""Sinks, run persistence and stream = batch checks."""

import struct
import zlib

from pyspark.sql import functions as F

from trustframe.operators import calllog as C
from trustframe.session import scratch_path
from trustframe.sources import tables as TB
from trustframe.sources import testdata as td


def _uniq(spark, name):
    import uuid
    return scratch_path(spark, f"tests/{name}-{uuid.uuid4().hex}")


def test_append_log_partitions_by_day(spark, sf_dir):
    path = _uniq(spark, "calls")
    calls = td.api_calls(spark, sf_dir)
    C.append_log(calls, path)
    C.append_log(calls.limit(10), path)
    back = spark.read.parquet(path)
    assert back.count() == calls.count() + 10
    assert "day" in back.columns
    # the day predicate prunes partitions
    plan = back.filter(F.col("day") == "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_write_and_read_accounts_csv(spark, sf_dir):
    path = _uniq(spark, "accounts")
    a = td.accounts(spark, sf_dir)
    TB.write_accounts(a, path, "csv")
    back = TB.read_accounts(spark, path, "csv")
    assert back.count() == a.count()
    assert TB.maybe_split(spark, _uniq(spark, "missing")) is None


def test_save_and_load_run(spark, sf_dir):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    a = td.accounts(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["followers_count", "tweet_count"], outputCol="features"),
                             LogisticRegression(maxIter=5)]).fit(a)
    run = _uniq(spark, "run")
    TB.save_run(model, {"optimal_threshold": 0.42, "n_features": 2}, run, spark)
    m2, summary, th, _ = TB.load_run(run, spark)
    assert th == 0.42 and summary["n_features"] == 2
    assert m2.transform(a).count() == a.count()
    run2 = _uniq(spark, "run")
    TB.save_run(model, {"n_features": 2}, run2, spark)
    assert TB.load_run(run2, spark)[2] == 0.30


def _png(w, h, rgb):
    raw = b"".join(b"\x00" + bytes(rgb) * w for _ in range(h))

    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images_quarantines_undecodable(spark):
    import os
    d = _uniq(spark, "images")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "a.png"), "wb") as f:
        f.write(_png(3, 2, (10, 20, 30)))
    with open(os.path.join(d, "bad.png"), "wb") as f:
        f.write(b"not an image")
    ok, bad = TB.read_images(spark, d)
    r = ok.first()
    assert (r["width"], r["height"]) == (3, 2)
    assert bytes(r["data"][:3]) == bytes([30, 20, 10])     # BGR order
    assert bad.count() == 1


def test_stream_hourly_equals_batch(spark, sf_dir):
    from trustframe.plans.registry import queries
    s = queries()["stream_hourly"](spark, sf_dir)
    b = (td.api_calls(spark, sf_dir)
         .groupBy(F.date_format(F.date_trunc("hour", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"))
         .agg(F.count(F.lit(1)).alias("count")))
    assert s.select("window_start", "count").exceptAll(b).count() == 0
    assert b.exceptAll(s.select("window_start", "count")).count() == 0


def test_stream_installs_equal_distinct(spark, sf_dir):
    from trustframe.plans.registry import queries
    s = queries()["stream_installs"](spark, sf_dir)
    n = td.extension_pings(spark, sf_dir).agg(F.count_distinct("extension_id")).first()[0]
    assert s.count() == n


# ---- round 2: folders, text ids, rejects, saved chain, late rows --------------------

def test_streams_read_folder_tables_and_new_files(spark, sf_dir):
    from trustframe.plans.registry import queries
    folder = _uniq(spark, "folder")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    got = queries()["stream_daily"](spark, folder)
    assert got.agg(F.sum("count")).first()[0] == events.count()
    events.limit(5).write.mode("append").parquet(f"{folder}/events.parquet")
    assert queries()["stream_daily"](spark, folder).agg(F.sum("count")).first()[0] == events.count() + 5


def test_text_ids_from_csv_to_labels(spark):
    from trustframe.operators.labels import join_labels, train_labels
    from trustframe.schemas import BIN_BASE, NUM_BASE
    import os
    path = _uniq(spark, "ids")
    os.makedirs(path)
    with open(f"{path}/users.csv", "w") as f:
        f.write(",".join(["id", *NUM_BASE, *BIN_BASE, "label"]) + "\n")
        f.write(",".join(["u123", *["1"] * 12, "1"]) + "\n")
    for name, line in (("label", "id,label\nu123,bot\n"), ("split", "id,split\nu123,train\n")):
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(line)
    a = TB.read_accounts(spark, f"{path}/users.csv")
    lab = train_labels(TB.read_labels(spark, f"{path}/label.csv"), TB.maybe_split(spark, f"{path}/split.csv"))
    rows = join_labels(a, lab).collect()
    assert [(r["id"], r["label"], r["followers_count"]) for r in rows] == [("u123", "bot", 1.0)]


def test_unreadable_raw_files_become_rejects(spark):
    import os
    from trustframe.sources.raw_json import accepted_raw, read_raw_accounts, rejected_raw, unwrap_accounts
    path = _uniq(spark, "raw")
    os.makedirs(path)
    files = {"array": '[{"id": 1}, [2, {"id": 2}], 5]', "object": '\n\n {"id": 3}', "truncated": '[{"id": 4}, {"id"',
             "garbage": "not json", "empty": "[]", "lines": '\n [ {"id": 6} ] \n'}
    for name, text in files.items():
        with open(f"{path}/{name}.json", "w") as f:
            f.write(text)
    u = unwrap_accounts(read_raw_accounts(spark, path))
    ids = sorted(r[0] for r in accepted_raw(u).select(F.try_variant_get("obj", "$.id", "int")).collect())
    assert ids == [1, 2, 3, 4, 6]                  # the truncated file keeps its whole element
    assert rejected_raw(u).count() == 3            # 5, the truncated file, the garbage file


def test_checkpoint_folder_is_required_off_local():
    import pytest
    from trustframe import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
    assert session.is_local("local[4]") and not session.is_local("local-cluster[1,1,1024]")


def test_production_chain_saves_loads_and_scores_alike(spark, sf_dir):
    from trustframe.plans import training as T
    acc = td.scored_accounts(spark, sf_dir)
    members, summary = T.train_production(acc, n_iter=1, folds=2, trees=5)
    run = _uniq(spark, "chain")
    TB.save_run(members, summary, run, spark, list(T.FEATURES))
    again, s2, th, schema = TB.load_run(run, spark)
    assert th == summary["optimal_threshold"] and schema["feature_list"] == list(T.FEATURES)
    assert s2["best_params"] == summary["best_params"] and set(s2["test_metrics"]) == {
        "report", "confusion_matrix", "roc_auc"}
    one = {r["id"]: r for r in T.score_accounts(acc, members, th).collect()}
    two = {r["id"]: r for r in T.score_accounts(acc, again, th).collect()}
    assert one and one == two
    iso = T.calibrated_forest(T.training_frame(acc), "isotonic", folds=2, trees=5)
    TB.save_run(iso, {}, run + "-iso", spark)
    back = TB.load_run(run + "-iso", spark)
    test = T.training_frame(acc)
    assert T.predict_calibrated(iso, test, "isotonic").select("score").collect() == \
        T.predict_calibrated(back[0], test, "isotonic").select("score").collect()
    assert back[2] == 0.30


def test_append_stream_drops_exactly_the_late_rows_and_restarts(spark):
    from trustframe.streaming import streams as R
    folder = _uniq(spark, "late")
    out, ckpt = _uniq(spark, "late-out"), _uniq(spark, "late-ckpt")

    def add(*times):
        (spark.createDataFrame([(i, t, 0, 10.0) for i, t in enumerate(times)],
                               "id long, t string, error int, response_time_ms double")
         .select("id", F.to_timestamp_ntz("t").alias("timestamp"), "error", "response_time_ms")
         .coalesce(1).write.mode("append").parquet(f"{folder}/calls.parquet"))

    def run():
        df = R.windowed_calls(R.file_stream(spark, folder, "calls"), "1 hour").select(
            F.date_format("w.start", "HH:mm").alias("start"), "count")
        q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    add("2024-01-01 01:10:00", "2024-01-01 01:20:00")
    run()
    add("2024-01-01 05:00:00")          # moves the watermark to 04:00
    run()
    add("2024-01-01 01:30:00", "2024-01-01 05:10:00")    # the first is late now
    run()
    add("2024-01-01 09:00:00")
    run()
    got = {r["start"]: r["count"] for r in spark.read.parquet(out).collect()}
    assert got["01:00"] == 2 and got["05:00"] == 2


def test_stream_call_log_has_ids_days_and_no_invented_latency(spark):
    from trustframe.streaming.streams import scoring_batch_writer
    base = _uniq(spark, "scoring")
    rows = spark.createDataFrame([(1, 0.5), (2, 0.7)], "id long, bot_probability double")
    write = scoring_batch_writer(f"{base}/scored", f"{base}/calls")
    write(rows, 0)
    write(rows, 0)                      # a replayed batch overwrites itself
    log = spark.read.parquet(f"{base}/calls")
    assert log.count() == 2 and "day" in log.columns
    assert log.filter("response_time_ms IS NOT NULL").count() == 0
    assert log.select("id").distinct().count() == 2


# ---- chained stateful steps ------------------------------------------------------

def _pings_by_day(spark, days, ids_of):
    """One ordered list of pings per day: (id, timestamp, extension_id, version)."""
    out = []
    for d in range(days):
        rows = [(100 * d + i, f"2024-01-{d + 1:02} {i % 24:02}:{i % 60:02}:00", e, "1.0")
                for i, e in enumerate(ids_of(d))]
        out.append(spark.createDataFrame(rows, "id long, timestamp string, extension_id string, version string")
                   .withColumn("timestamp", F.to_timestamp_ntz("timestamp")))
    return out


def test_install_counts_equal_batch_counts_and_survive_a_restart(spark):
    from trustframe.streaming import streams as R
    R.rocksdb_state(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == R.ROCKSDB
    folder, out, ckpt = (_uniq(spark, f"installs-{x}") for x in ("in", "out", "ckpt"))
    days = _pings_by_day(spark, 9, lambda d: [None, *(f"e{4 * d + i}" for i in range(6)), f"e{4 * d}"])

    def run():      # every call is a new query on the old checkpoint
        df = R.install_counts(R.file_stream(spark, folder, "pings", max_files=1), horizon="2 days").select(
            F.date_format("w.start", "yyyy-MM-dd").alias("day"), "new_installs")
        q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    for some in (days[:4], days[4:7], days[7:]):
        for d in some:
            d.coalesce(1).write.mode("append").parquet(f"{folder}/pings.parquet")
        run()
    got = {r["day"]: r["new_installs"] for r in spark.read.parquet(out).collect()}

    want, seen = {}, set()
    for d, rows in enumerate(days):
        new = {r["extension_id"] for r in rows.collect()} - seen - {None}
        seen |= new
        want[f"2024-01-{d + 1:02}"] = len(new)
    assert len(got) >= 5 and got == {d: want[d] for d in got}      # the others are still open


def test_active_installs_of_closed_days(spark):
    from trustframe.streaming import streams as R
    R.rocksdb_state(spark)
    folder = _uniq(spark, "active")
    days = _pings_by_day(spark, 4, lambda d: [None] + [f"e{i % (d + 2)}" for i in range(12)])
    for d in days:
        d.coalesce(1).write.mode("append").parquet(f"{folder}/pings.parquet")
    got = R.run_available(R.active_installs(R.file_stream(spark, folder, "pings")).select(
        F.dayofmonth("w.start").alias("day"), "installs"), "active", mode="append")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 3), (3, 4)]
