"""Registered queries: Structured Streaming jobs run with ``availableNow``.

Each query streams the Parquet test table, runs to completion and returns
the sink's content as a batch DataFrame (rows-only checks; the streaming
results equal the batch queries on the same rows, see tests).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators.validation import validate_accounts
from ..session import materialize, scratch_path
from ..sources import testdata as td
from ..streaming import streams as R
from .oracle_fixtures import with_fixtures
from .registry import query, r6


def _window_sql(unit: str, step: str) -> str:
    """Batch twin of the streamed tumbling windows (the stream sees every row once)."""
    return with_fixtures(["api_calls"], f"""SELECT strftime(date_trunc('{unit}', timestamp), '%Y-%m-%dT%H:%M:%S') AS window_start,
  strftime(date_trunc('{unit}', timestamp) + INTERVAL {step}, '%Y-%m-%dT%H:%M:%S') AS window_end,
  COUNT(*) AS "count", ROUND(AVG(CASE WHEN error = 0 THEN response_time_ms END), 6) AS avg_ms
FROM api_calls GROUP BY date_trunc('{unit}', timestamp)""")


def _window_rows(df):
    return df.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss").alias("window_start"),
                     F.date_format("w.end", "yyyy-MM-dd'T'HH:mm:ss").alias("window_end"),
                     "count", r6("avg_ms").alias("avg_ms"))


@query("stream_hourly", _window_sql("hour", "1 HOUR"))
def stream_hourly(spark, sf_dir):
    calls = td.calls_from_events(R.file_stream(spark, sf_dir, "events"))
    res = R.run_available(_window_rows(R.windowed_calls(calls, "1 hour")), "hourly",
                          key_cols=["window_start"])
    return res


@query("stream_daily", _window_sql("day", "1 DAY"))
def stream_daily(spark, sf_dir):
    calls = td.calls_from_events(R.file_stream(spark, sf_dir, "events"))
    return R.run_available(_window_rows(R.windowed_calls(calls, "1 day")), "daily",
                           key_cols=["window_start"])


@query("stream_installs")
def stream_installs(spark, sf_dir):
    pings = td.pings_from_events(R.file_stream(spark, sf_dir, "events"))
    firsts = R.unique_install_events(pings).select(
        "extension_id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen"), "version")
    return R.run_available(firsts, "installs", mode="append")


@query("stream_installs_count", with_fixtures(["extension_pings"],
       "SELECT COUNT(DISTINCT extension_id) AS unique_installs FROM extension_pings"))
def stream_installs_count(spark, sf_dir):
    """Downstream count of the deduplicated stream."""
    return stream_installs(spark, sf_dir).agg(F.count(F.lit(1)).alias("unique_installs"))


@query("stream_active_installs", with_fixtures(["extension_pings"], """
SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, COUNT(DISTINCT extension_id) AS installs
FROM extension_pings WHERE extension_id IS NOT NULL
GROUP BY 1, date_trunc('day', timestamp)
HAVING date_trunc('day', timestamp) + INTERVAL 1 DAY
       <= (SELECT MAX(timestamp) - INTERVAL 1 HOUR FROM extension_pings WHERE extension_id IS NOT NULL)"""))
def stream_active_installs(spark, sf_dir):
    """Installs per day out of the chained stream: the days that the watermark has closed."""
    R.rocksdb_state(spark)
    pings = td.pings_from_events(R.file_stream(spark, sf_dir, "events"))
    days = R.active_installs(pings).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "installs")
    return R.run_available(days, "active", mode="append")


def _scoring_sql() -> str:
    from .q_accounts import HEUR_SQL
    return with_fixtures(["scored"], f"""SELECT id, p AS bot_probability,
  CASE WHEN p >= 0.60 THEN 'High' WHEN p >= 0.30 THEN 'Medium' ELSE 'Low' END AS risk_level,
  p >= 0.30 AS is_bot, ROUND(heur, 6) AS heuristic_score,
  ROUND(LEAST(GREATEST(0.6e0 * (1.0e0 - p) + 0.4e0 * heur, 0.0e0), 1.0e0), 6) AS trust_score
FROM (SELECT *, {HEUR_SQL} AS heur FROM scored) s
WHERE followers_count >= 0 AND following_count >= 0 AND tweet_count >= 0 AND account_age_days > 0""")


@query("stream_scoring", _scoring_sql())
def stream_scoring(spark, sf_dir):
    """New customers arrive as a stream; each micro-batch is joined to the static
    order aggregates (stream-static join), validated, scored and written to the
    scored table and the call log."""
    cust = R.file_stream(spark, sf_dir, "customer")
    # the static side is aggregated and written once, not once per micro-batch
    totals = materialize(td.order_totals(spark, sf_dir))
    acc = td.accounts(spark, sf_dir, customers=cust, totals=totals)
    v = validate_accounts(acc)
    p = td.probability_of(F.col("id"))
    scored = v.filter(F.col("status") == "accepted").select(
        "id", p.alias("bot_probability"), S.risk_level(p).alias("risk_level"), S.is_bot(p).alias("is_bot"),
        r6(S.heuristic_score()).alias("heuristic_score"),
        r6(S.trust_score_raw(p, S.heuristic_score())).alias("trust_score"))
    base = scratch_path(spark, f"streams/scoring-{uuid.uuid4().hex}")
    q = (scored.writeStream.foreachBatch(R.scoring_batch_writer(f"{base}/scored", f"{base}/calls"))
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/scored").drop("batch_id")
