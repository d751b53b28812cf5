"""Registered queries: event-log analytics and the report derived from it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import calllog as C
from ..operators import scoring as S
from ..operators import sketches as K
from ..session import scratch_path
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import ORACLE, query, r6

# event logs written in this session, by the state of the files they come from
_LOGS: dict = {}
AS_OF = td.AS_OF_DAY
AS_OF_30 = td.AS_OF_MONTH
# bounds of the oracle texts, written out for as_of 2024-01-30 and 2024-02-10
DAY_LO, DAY_HI = "2024-01-30 00:00:00", "2024-01-31 00:00:00"
H_LO = "2024-01-29 00:00:00"
D_LO = "2024-01-11 00:00:00"


def _calls(spark, sf_dir):
    return td.api_calls(spark, sf_dir)


def _pings(spark, sf_dir):
    return td.extension_pings(spark, sf_dir)


def _logs(spark, sf_dir):
    """The call log (two batches, older and newer ids) and the ping log of the events table."""
    key = (spark.sparkContext.applicationId, td.listing(spark, f"{sf_dir}/events.parquet"))
    if key not in _LOGS:
        base = scratch_path(spark, f"logs/{uuid.uuid4().hex}")
        calls = _calls(spark, sf_dir)
        half = F.lit(calls.agg(F.percentile_approx("id", 0.5)).first()[0])
        C.append_log(calls.filter(F.col("id") <= half), f"{base}/calls", "older")
        C.append_log(calls.filter(F.col("id") > half), f"{base}/calls", "newer")
        C.ping_log(spark, f"{base}/pings").append(_pings(spark, sf_dir), "all")
        _LOGS[key] = base
    return C.call_log(spark, f"{_LOGS[key]}/calls"), C.ping_log(spark, f"{_LOGS[key]}/pings")


def _q(name, fixtures, sql):
    return query(name, with_fixtures(fixtures, sql))


@_q("total_calls", ["api_calls"], "SELECT COUNT(*) AS total_calls FROM api_calls WHERE error = 0")
def total_calls(spark, sf_dir):
    return C.total_calls(_calls(spark, sf_dir))


@_q("calls_today", ["api_calls"], f"""SELECT COUNT(*) AS calls_today FROM api_calls
WHERE error = 0 AND timestamp >= TIMESTAMP '{DAY_LO}' AND timestamp < TIMESTAMP '{DAY_HI}'""")
def calls_today(spark, sf_dir):
    return C.calls_today(_calls(spark, sf_dir), AS_OF)


@_q("avg_bot_last1000", ["api_calls"], """SELECT ROUND(AVG(bot_probability), 6) AS avg_bot_probability
FROM (SELECT bot_probability FROM api_calls WHERE bot_probability IS NOT NULL ORDER BY id DESC LIMIT 1000) x""")
def avg_bot_last1000(spark, sf_dir):
    return C.avg_bot_last(_calls(spark, sf_dir)).select(r6("avg_bot_probability").alias("avg_bot_probability"))


@_q("avg_rt_last1000", ["api_calls"], """SELECT ROUND(AVG(response_time_ms), 6) AS avg_response_time_ms
FROM (SELECT response_time_ms FROM api_calls WHERE error = 0 ORDER BY id DESC LIMIT 1000) x""")
def avg_rt_last1000(spark, sf_dir):
    return C.avg_rt_last(_calls(spark, sf_dir)).select(r6("avg_response_time_ms").alias("avg_response_time_ms"))


@_q("unique_installs", ["extension_pings"],
    "SELECT COUNT(DISTINCT extension_id) AS unique_installs FROM extension_pings WHERE extension_id IS NOT NULL")
def unique_installs(spark, sf_dir):
    return C.unique_installs(_pings(spark, sf_dir))


@_q("total_pings", ["extension_pings"], "SELECT COUNT(*) AS total_pings FROM extension_pings")
def total_pings(spark, sf_dir):
    return C.total_pings(_pings(spark, sf_dir))


@_q("risk_breakdown", ["api_calls"], """SELECT risk_level, COUNT(*) AS "count" FROM api_calls
WHERE risk_level IS NOT NULL GROUP BY risk_level""")
def risk_breakdown(spark, sf_dir):
    return C.risk_breakdown(_calls(spark, sf_dir))


@_q("daily_calls", ["api_calls"], f"""SELECT strftime(timestamp, '%Y-%m-%d') AS day, COUNT(*) AS "count"
FROM api_calls WHERE timestamp >= TIMESTAMP '{D_LO}' GROUP BY 1 ORDER BY 1""")
def daily_calls(spark, sf_dir):
    return C.daily_calls(_calls(spark, sf_dir), AS_OF_30)


@_q("hourly_calls", ["api_calls"], f"""SELECT strftime(timestamp, '%Y-%m-%dT%H:00:00') AS hour, COUNT(*) AS "count"
FROM api_calls WHERE timestamp >= TIMESTAMP '{H_LO}' GROUP BY 1 ORDER BY 1""")
def hourly_calls(spark, sf_dir):
    return C.hourly_calls(_calls(spark, sf_dir), AS_OF)


_RT_TREND_SQL = f"""SELECT strftime(timestamp, '%Y-%m-%dT%H:00:00') AS hour, ROUND(AVG(response_time_ms), 6) AS avg_ms
FROM api_calls WHERE timestamp >= TIMESTAMP '{H_LO}' AND error = 0 GROUP BY 1"""


@_q("rt_trend", ["api_calls"], _RT_TREND_SQL)
def rt_trend(spark, sf_dir):
    return C.rt_trend(_calls(spark, sf_dir), AS_OF, digits=6)


@_q("slow_hours", ["api_calls"], f"SELECT * FROM ({_RT_TREND_SQL}) x WHERE avg_ms > 200")
def slow_hours(spark, sf_dir):
    return C.slow_hours(C.rt_trend(_calls(spark, sf_dir), AS_OF, digits=6))


# the log with four times the latencies: about half of its hours are above the target
_SLOW_SQL = _RT_TREND_SQL.replace("AVG(response_time_ms)", "AVG(response_time_ms * 4)")


@_q("slow_hours_loaded", ["api_calls"], f"SELECT * FROM ({_SLOW_SQL}) x WHERE avg_ms > 200")
def slow_hours_loaded(spark, sf_dir):
    calls = _calls(spark, sf_dir).withColumn("response_time_ms", F.col("response_time_ms") * 4)
    return C.slow_hours(C.rt_trend(calls, AS_OF, digits=6))


def _last_sql(col, n=500):
    return f"""SELECT id, {col} FROM api_calls WHERE {col} IS NOT NULL ORDER BY id DESC LIMIT {n}"""


@_q("last_bot_probs", ["api_calls"], _last_sql("bot_probability"))
def last_bot_probs(spark, sf_dir):
    return C.last_scores(_calls(spark, sf_dir), "bot_probability")


@_q("last_image_risks", ["api_calls"], _last_sql("image_risk_score"))
def last_image_risks(spark, sf_dir):
    return C.last_scores(_calls(spark, sf_dir), "image_risk_score")


@_q("recent_calls", ["api_calls"], """SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, endpoint,
  bot_probability, image_risk_score, risk_level, response_time_ms, error
FROM api_calls ORDER BY id DESC LIMIT 25""")
def recent_calls(spark, sf_dir):
    r = C.recent_calls(_calls(spark, sf_dir))
    return r.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@_q("recent_calls_report", ["api_calls"], """SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS "Time (UTC)",
  endpoint AS "Endpoint", COALESCE(printf('%.1f%%', bot_probability * 100), '—') AS "Bot Prob",
  COALESCE(printf('%.1f%%', image_risk_score * 100), '—') AS "Image Risk", risk_level AS "Risk Level",
  COALESCE(printf('%.0f ms', response_time_ms), '—') AS "Response Time",
  CASE WHEN COALESCE(error, 0) <> 0 THEN 'Yes' ELSE 'No' END AS "Error"
FROM api_calls ORDER BY id DESC LIMIT 25""")
def recent_calls_report(spark, sf_dir):
    return C.recent_calls_report(C.recent_calls(_calls(spark, sf_dir)))


@_q("stats_summary", ["api_calls", "extension_pings"], f"""SELECT
  (SELECT COUNT(*) FROM api_calls WHERE error = 0) AS total_calls,
  (SELECT COUNT(*) FROM api_calls WHERE error = 0 AND timestamp >= TIMESTAMP '{DAY_LO}'
          AND timestamp < TIMESTAMP '{DAY_HI}') AS calls_today,
  (SELECT COALESCE(ROUND(AVG(bot_probability), 6), 0.0) FROM (SELECT bot_probability FROM api_calls
          WHERE bot_probability IS NOT NULL ORDER BY id DESC LIMIT 1000) x) AS avg_bot_probability,
  (SELECT COALESCE(ROUND(AVG(response_time_ms), 6), 0.0) FROM (SELECT response_time_ms FROM api_calls
          WHERE error = 0 ORDER BY id DESC LIMIT 1000) y) AS avg_response_time_ms,
  (SELECT COUNT(DISTINCT extension_id) FROM extension_pings) AS unique_installs,
  (SELECT COUNT(*) FROM extension_pings) AS total_pings""")
def stats_summary(spark, sf_dir):
    return C.stats_summary(_calls(spark, sf_dir), _pings(spark, sf_dir), AS_OF, digits=(6, 6))


def _newest_sql(col):
    return f"(SELECT string_agg(printf('%.3f', {col}), ',' ORDER BY id DESC) FROM ({_last_sql(col)}) x)"


@_q("stats_report", ["api_calls", "extension_pings"], f"""SELECT
  (SELECT COUNT(*) FROM api_calls WHERE error = 0) AS total_calls,
  (SELECT COUNT(*) FROM api_calls WHERE error = 0 AND timestamp >= TIMESTAMP '{DAY_LO}'
          AND timestamp < TIMESTAMP '{DAY_HI}') AS calls_today,
  (SELECT COALESCE(ROUND(AVG(bot_probability), 6), 0.0) FROM (SELECT bot_probability FROM api_calls
          WHERE bot_probability IS NOT NULL ORDER BY id DESC LIMIT 1000) x) AS avg_bot_probability,
  (SELECT COALESCE(ROUND(AVG(response_time_ms), 6), 0.0) FROM (SELECT response_time_ms FROM api_calls
          WHERE error = 0 ORDER BY id DESC LIMIT 1000) y) AS avg_response_time_ms,
  (SELECT COUNT(DISTINCT extension_id) FROM extension_pings) AS unique_installs,
  (SELECT COUNT(*) FROM extension_pings) AS total_pings,
  (SELECT string_agg(risk_level || ':' || n, ',' ORDER BY risk_level) FROM (SELECT risk_level, COUNT(*) AS n
          FROM api_calls WHERE risk_level IS NOT NULL GROUP BY 1) r) AS risk_breakdown,
  (SELECT string_agg(day || ':' || n, ',' ORDER BY day) FROM (SELECT strftime(timestamp, '%Y-%m-%d') AS day,
          COUNT(*) AS n FROM api_calls WHERE timestamp >= TIMESTAMP '{D_LO}' GROUP BY 1) d) AS daily_calls,
  (SELECT string_agg(hour || ':' || n, ',' ORDER BY hour) FROM (SELECT strftime(timestamp, '%Y-%m-%dT%H:00:00') AS hour,
          COUNT(*) AS n FROM api_calls WHERE timestamp >= TIMESTAMP '{H_LO}' GROUP BY 1) h) AS hourly_calls,
  {_newest_sql("bot_probability")} AS bot_probabilities,
  {_newest_sql("image_risk_score")} AS image_risk_scores,
  (SELECT string_agg(strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || ' ' || endpoint || ' ' || COALESCE(risk_level, '-')
          || ' ' || error, ',' ORDER BY id DESC)
   FROM (SELECT * FROM api_calls ORDER BY id DESC LIMIT 25) c) AS recent_calls,
  (SELECT string_agg(hour || ':' || printf('%.6f', avg_ms), ',' ORDER BY hour) FROM ({_RT_TREND_SQL}) t) AS rt_trend""")
def stats_report(spark, sf_dir):
    """The 13 parts of the record; maps and lists of rows are shown as text."""
    return _report_text(C.stats_report(_calls(spark, sf_dir), _pings(spark, sf_dir), AS_OF, AS_OF_30,
                                       digits=(6, 6)))


def _report_text(r):
    def text(col, show):
        return F.array_join(F.transform(col, show), ",").alias(col)

    return r.select(
        "total_calls", "calls_today", "avg_bot_probability", "avg_response_time_ms", "unique_installs",
        "total_pings",
        F.array_join(F.transform(F.map_entries("risk_breakdown"), lambda e: F.concat_ws(
            ":", e["key"], e["value"].cast("string"))), ",").alias("risk_breakdown"),
        text("daily_calls", lambda e: F.concat_ws(":", e["day"], e["count"].cast("string"))),
        text("hourly_calls", lambda e: F.concat_ws(":", e["hour"], e["count"].cast("string"))),
        text("bot_probabilities", lambda x: F.format_string("%.3f", x)),
        text("image_risk_scores", lambda x: F.format_string("%.3f", x)),
        text("recent_calls", lambda e: F.concat_ws(
            " ", F.date_format(e["timestamp"], "yyyy-MM-dd'T'HH:mm:ss"), e["endpoint"],
            F.coalesce(e["risk_level"], F.lit("-")), e["error"].cast("string"))),
        text("rt_trend", lambda e: F.concat_ws(":", e["hour"], F.format_string("%.6f", e["avg_ms"]))))


@_q("ping_activity", ["extension_pings"], """SELECT COUNT(*) AS total_pings,
  COUNT(DISTINCT extension_id) AS unique_installs FROM extension_pings""")
def ping_activity(spark, sf_dir):
    return _pings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total_pings"),
                                     F.count_distinct("extension_id").alias("unique_installs"))


def _hist_sql(col):
    return f"""SELECT CAST(LEAST(FLOOR({col} * 25), 24) AS INTEGER) AS bin, COUNT(*) AS "count"
FROM ({_last_sql(col)}) x GROUP BY 1"""


@_q("hist_bot_probability", ["api_calls"], _hist_sql("bot_probability"))
def hist_bot_probability(spark, sf_dir):
    return C.histogram(C.last_scores(_calls(spark, sf_dir), "bot_probability"), "bot_probability")


@_q("hist_image_risk", ["api_calls"], _hist_sql("image_risk_score"))
def hist_image_risk(spark, sf_dir):
    return C.histogram(C.last_scores(_calls(spark, sf_dir), "image_risk_score"), "image_risk_score")


@_q("flagged_share", ["api_calls"], f"""SELECT COUNT(*) FILTER (WHERE bot_probability >= 0.30) AS flagged,
  COUNT(*) AS total, ROUND(COUNT(*) FILTER (WHERE bot_probability >= 0.30) / COUNT(*), 6) AS share
FROM ({_last_sql('bot_probability')}) x""")
def flagged_share(spark, sf_dir):
    f = C.flagged_share(C.last_scores(_calls(spark, sf_dir), "bot_probability"))
    return f.select("flagged", "total", r6("share").alias("share"))


@_q("high_image_count", ["api_calls"], f"""SELECT COUNT(*) FILTER (WHERE image_risk_score >= 0.60) AS high,
  COUNT(*) AS total FROM ({_last_sql('image_risk_score')}) x""")
def high_image_count(spark, sf_dir):
    f = C.flagged_share(C.last_scores(_calls(spark, sf_dir), "image_risk_score"), "image_risk_score",
                        C.HIGH_IMAGE)
    return f.select(F.col("flagged").alias("high"), "total")


@_q("risk_share", ["api_calls"], """SELECT risk_level, "count", ROUND("count" / SUM("count") OVER (), 6) AS share
FROM (SELECT risk_level, COUNT(*) AS "count" FROM api_calls WHERE risk_level IS NOT NULL GROUP BY 1) x""")
def risk_share(spark, sf_dir):
    s = C.risk_share(C.risk_breakdown(_calls(spark, sf_dir)))
    return s.select("risk_level", "count", r6("share").alias("share"))


# ---- describe from per-day sketches (A3 at scale) -------------------------------

_SKETCHED = ("response_time_ms", "bot_probability", "image_risk_score")


def _sketch_sql() -> str:
    """One pass over all rows with the sketch's buckets."""
    parts = ", ".join(f"""
  min(CASE WHEN cum > floor({p} * (n - 1)) THEN bucket END) AS lo{i},
  min(CASE WHEN cum > ceil({p} * (n - 1)) THEN bucket END) AS hi{i}""" for i, p in enumerate((0.1, 0.5, 0.9)))

    def rep(b):
        return (f"greatest(min, least(max, CASE WHEN {b} = 0 THEN 0.0 ELSE sign({b}) * pow({K.GROWTH!r}, "
                f"abs({b}) - {K.SHIFT}) * {2 / (K.GROWTH + 1)!r} END))")
    out = ", ".join(f"""
  ROUND({rep(f'lo{i}')} + ({rep(f'hi{i}')} - {rep(f'lo{i}')})
        * ({p} * ("count" - 1) - floor({p} * ("count" - 1))), 6) AS p{round(p * 100)}"""
                    for i, p in enumerate((0.1, 0.5, 0.9)))
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM api_calls" for c in _SKETCHED)
    return f"""
, u AS ({each})
, h AS (SELECT feature, CASE WHEN v = 0 THEN 0 ELSE CAST(sign(v) AS BIGINT)
          * CAST(ceil(ln(abs(v)) / {math.log(K.GROWTH)!r}) + {K.SHIFT} AS BIGINT) END AS bucket, COUNT(*) AS c
        FROM u WHERE v IS NOT NULL GROUP BY 1, 2)
, b AS (SELECT *, SUM(c) OVER (PARTITION BY feature ORDER BY bucket) AS cum, SUM(c) OVER (PARTITION BY feature) AS n FROM h)
, q AS (SELECT feature, {parts} FROM b GROUP BY feature)
, m AS (SELECT feature, COUNT(v) AS "count", AVG(v) AS mean, STDDEV_SAMP(v) AS std, MIN(v) AS min, MAX(v) AS max
        FROM u WHERE v IS NOT NULL GROUP BY feature)
SELECT feature, "count", ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, ROUND(min, 6) AS min, ROUND(max, 6) AS max, {out}
FROM m JOIN q USING (feature)"""


@_q("calls_describe_sketch", ["api_calls"], _sketch_sql())
def calls_describe_sketch(spark, sf_dir):
    """Statistics of the call log out of one sketch per day."""
    days = K.sketch(_calls(spark, sf_dir).withColumn("day", F.to_date("timestamp")), _SKETCHED, ("day",))
    d = K.describe(K.merge(days))
    return d.select("feature", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "max", "p10", "p50", "p90")])


# ---- call-log sink projections (S8 / B3, S9) ----------------------------------

@_q("log_calls_projection", ["scored"], """SELECT id, 'analyze_user' AS endpoint,
  ROUND(followers_count * 1.25e0, 2) AS response_time_ms, p AS bot_probability,
  CAST(NULL AS DOUBLE) AS image_risk_score,
  CASE WHEN p >= 0.60 THEN 'High' WHEN p >= 0.30 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN p >= 0.30 THEN 1 ELSE 0 END AS is_bot, 0 AS error
FROM scored""")
def log_calls_projection(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    batch = s.select("id", F.col("id").alias("event_id"), (F.col("followers_count") * 1.25).alias("response_time_ms"),
                     F.col("p").alias("bot_probability"), S.risk_level("p").alias("risk_level"),
                     S.is_bot("p").alias("is_bot"))
    return C.call_log_rows(batch).drop("timestamp")


@_q("ping_normalise", [], """SELECT event_id AS id,
  COALESCE(NULLIF(CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END, ''),
           NULLIF(CASE WHEN user_id % 2 = 0 THEN CONCAT('hdr-', CAST(user_id AS VARCHAR)) WHEN user_id % 5 = 0 THEN '' END, '')) AS extension_id,
  COALESCE(NULLIF(CASE WHEN user_id % 4 = 0 THEN '' ELSE '1.1' END, ''),
           NULLIF(CASE WHEN user_id % 8 = 0 THEN '1.0' END, '')) AS version
FROM events WHERE event_type = 'signup'""")
def ping_normalise(spark, sf_dir):
    e = td.table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    u = F.col("user_id")
    raw = e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.when(u % 3 == 0, F.lit("")).otherwise(u.cast("string")).alias("extension_id"),
        F.when(u % 2 == 0, F.concat(F.lit("hdr-"), u.cast("string")))
         .when(u % 5 == 0, F.lit("")).alias("hdr_extension_id"),
        F.when(u % 4 == 0, F.lit("")).otherwise(F.lit("1.1")).alias("version"),
        F.when(u % 8 == 0, F.lit("1.0")).alias("hdr_version"),
    )
    return C.normalise_pings(raw).drop("timestamp")


# ---- the same figures from an event log: newest partitions first ------------------

@query("log_avg_bot_last1000", ORACLE["avg_bot_last1000"])
def log_avg_bot_last1000(spark, sf_dir):
    return C.avg_bot_last(_logs(spark, sf_dir)[0]).select(r6("avg_bot_probability").alias("avg_bot_probability"))


@query("log_avg_rt_last1000", ORACLE["avg_rt_last1000"])
def log_avg_rt_last1000(spark, sf_dir):
    return C.avg_rt_last(_logs(spark, sf_dir)[0]).select(r6("avg_response_time_ms").alias("avg_response_time_ms"))


@query("log_last_bot_probs", ORACLE["last_bot_probs"])
def log_last_bot_probs(spark, sf_dir):
    return C.last_scores(_logs(spark, sf_dir)[0], "bot_probability")


@query("log_last_image_risks", ORACLE["last_image_risks"])
def log_last_image_risks(spark, sf_dir):
    return C.last_scores(_logs(spark, sf_dir)[0], "image_risk_score")


@query("log_recent_calls", ORACLE["recent_calls"])
def log_recent_calls(spark, sf_dir):
    r = C.recent_calls(_logs(spark, sf_dir)[0])
    return r.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


@query("log_stats_report", ORACLE["stats_report"])
def log_stats_report(spark, sf_dir):
    calls, pings = _logs(spark, sf_dir)
    return _report_text(C.stats_report(calls, pings, AS_OF, AS_OF_30, digits=(6, 6)))
