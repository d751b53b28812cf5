"""Event-log analytics over the scoring-call and ping tables.

``as_of`` replaces "now" and is an explicit parameter.  Window bounds are
computed on the driver as literals (so the filters reach the Parquet scan as
pushed predicates) and follow the text-comparison rule of the original log:
the lower bound is midnight of the boundary day.  Top-k reads
(``ORDER BY id DESC LIMIT n``) plan as ``TakeOrderedAndProject``: a per-task
top-k and a merge of at most ``n`` rows per task, never a global sort.

``calls`` and ``pings`` may be DataFrames or an ``EventLog``: from a log the
newest rows come out of the few partitions that hold them, and whole-log counts
out of its commits.
"""

from __future__ import annotations

import datetime as dt

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import CALLS_SCHEMA, PINGS_SCHEMA
from ..sources.eventlog import EventLog

# ---- fixed values ----------------------------------------------------------
LAST_AVG_BOT = 1000          # mean bot probability over the last 1000 scored calls
LAST_AVG_RT = 1000           # mean latency over the last 1000 successful calls
LAST_SCORES = 500            # score lists shown in the report
LAST_CALLS = 25              # recent-calls table
DAILY_DAYS = 30
HOURLY_DAYS = 1
HIST_BINS = 25
FLAG_THRESHOLD = 0.30        # share of flagged profiles
HIGH_IMAGE = 0.60            # high-risk images
LATENCY_TARGET_MS = 200.0
DAY_FMT = "yyyy-MM-dd"
HOUR_FMT = "yyyy-MM-dd'T'HH:00:00"
# ---------------------------------------------------------------------------

TS = "timestamp"
# conditions whose newest rows are asked for; a log counts them per partition
COUNTED = {"bot_probability": lambda: F.col("bot_probability").isNotNull(),
           "image_risk_score": lambda: F.col("image_risk_score").isNotNull(),
           "ok": lambda: F.col("error") == 0}


def rows_of(table: DataFrame | EventLog) -> DataFrame:
    return table.read() if isinstance(table, EventLog) else table


def _as_of(as_of: str) -> dt.datetime:
    return dt.datetime.fromisoformat(as_of)


def window_start(as_of: str, days: int) -> str:
    """Midnight of the day ``days`` before ``as_of`` (boundary-day rule)."""
    d = (_as_of(as_of) - dt.timedelta(days=days)).date()
    return f"{d.isoformat()} 00:00:00"


def day_bounds(as_of: str) -> tuple[str, str]:
    d = _as_of(as_of).date()
    return f"{d.isoformat()} 00:00:00", f"{(d + dt.timedelta(days=1)).isoformat()} 00:00:00"


def _ts_ge(bound: str) -> Column:
    return F.col(TS) >= F.lit(bound).cast("timestamp_ntz")


def _ts_lt(bound: str) -> Column:
    return F.col(TS) < F.lit(bound).cast("timestamp_ntz")


def since(calls: DataFrame, bound: str) -> DataFrame:
    """Rows from ``bound`` on; a log partitioned by day is pruned to those days."""
    calls = rows_of(calls)
    out = calls.filter(_ts_ge(bound))
    return out.filter(F.col("day") >= F.lit(bound[:10]).cast("date")) if "day" in calls.columns else out


def before(calls: DataFrame, bound: str) -> DataFrame:
    """Rows before the midnight ``bound``."""
    out = calls.filter(_ts_lt(bound))
    return out.filter(F.col("day") < F.lit(bound[:10]).cast("date")) if "day" in calls.columns else out


def ok(calls: DataFrame | EventLog) -> DataFrame:
    return rows_of(calls).filter(F.col("error") == 0)


# ---- single figures --------------------------------------------------------


def total_calls(calls: DataFrame | EventLog) -> DataFrame:
    if isinstance(calls, EventLog):
        return calls.total("ok").select(F.col("n").alias("total_calls"))
    return ok(calls).agg(F.count(F.lit(1)).alias("total_calls"))


def calls_today(calls: DataFrame, as_of: str) -> DataFrame:
    lo, hi = day_bounds(as_of)
    return before(since(ok(calls), lo), hi).agg(F.count(F.lit(1)).alias("calls_today"))


def last_n(calls: DataFrame | EventLog, n: int, what: str | None = None, cols=("*",)) -> DataFrame:
    """The ``n`` newest rows by id (that meet the counted condition ``what``), as a top-k."""
    df = calls.newest(n, what) if isinstance(calls, EventLog) else calls
    df = df if what is None else df.filter(COUNTED[what]())
    return df.orderBy(F.col("id").desc()).limit(n).select(*cols)


def avg_bot_last(calls: DataFrame | EventLog, n: int = LAST_AVG_BOT) -> DataFrame:
    """Mean of the newest ``n`` non-null bot probabilities (errors included)."""
    t = last_n(calls, n, "bot_probability", ("bot_probability",))
    return t.agg(F.avg("bot_probability").alias("avg_bot_probability"))


def avg_rt_last(calls: DataFrame | EventLog, n: int = LAST_AVG_RT) -> DataFrame:
    t = last_n(calls, n, "ok", ("response_time_ms",))
    return t.agg(F.avg("response_time_ms").alias("avg_response_time_ms"))


def or_zero(x: Column, digits: int) -> Column:
    """``round(x, d) if x else 0.0`` with a single reference to ``x`` (one subquery)."""
    return F.coalesce(F.round(F.nullif(x, F.lit(0.0)), digits), F.lit(0.0))


def unique_installs(pings: DataFrame) -> DataFrame:
    return pings.agg(F.count_distinct("extension_id").alias("unique_installs"))


def total_pings(pings: DataFrame) -> DataFrame:
    return pings.agg(F.count(F.lit(1)).alias("total_pings"))


# ---- grouped reports ---------------------------------------------------------


def risk_breakdown(calls: DataFrame) -> DataFrame:
    """Count per non-null risk level; case is kept (user and image calls differ)."""
    return (rows_of(calls).filter(F.col("risk_level").isNotNull())
            .groupBy("risk_level").agg(F.count(F.lit(1)).alias("count")))


def daily_calls(calls: DataFrame, as_of: str, days: int = DAILY_DAYS) -> DataFrame:
    """Calls per UTC day since midnight of the boundary day (errors included)."""
    return (since(calls, window_start(as_of, days))
            .groupBy(F.date_format(TS, DAY_FMT).alias("day"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("day"))


def hourly_calls(calls: DataFrame, as_of: str, days: int = HOURLY_DAYS) -> DataFrame:
    return (since(calls, window_start(as_of, days))
            .groupBy(F.date_format(TS, HOUR_FMT).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy("hour"))


def rt_trend(calls: DataFrame, as_of: str, days: int = HOURLY_DAYS, digits: int = 1) -> DataFrame:
    """Mean latency per hour of successful calls."""
    return (since(ok(calls), window_start(as_of, days))
            .groupBy(F.date_format(TS, HOUR_FMT).alias("hour"))
            .agg(F.round(F.avg("response_time_ms"), digits).alias("avg_ms"))
            .orderBy("hour"))


def slow_hours(trend: DataFrame, target_ms: float = LATENCY_TARGET_MS) -> DataFrame:
    """Hours whose mean latency is above the target line."""
    return trend.filter(F.col("avg_ms") > target_ms)


def last_scores(calls: DataFrame, col: str, n: int = LAST_SCORES) -> DataFrame:
    return last_n(calls, n, col, ("id", col))


def recent_calls(calls: DataFrame, n: int = LAST_CALLS) -> DataFrame:
    return last_n(calls, n, None, (TS, "endpoint", "bot_probability", "image_risk_score",
                                   "risk_level", "response_time_ms", "error"))


def recent_calls_report(recent: DataFrame) -> DataFrame:
    """Display form of the recent-calls table (renamed, formatted, '—' for NULL)."""
    def shown(c, form, value):      # format_string prints NULL as text
        return F.when(F.col(c).isNotNull(), F.format_string(form, value)).otherwise("—")

    def pct(c):
        return shown(c, "%.1f%%", F.bround(F.col(c) * 100, 1))     # halves go to the even digit
    return recent.select(
        F.date_format(TS, "yyyy-MM-dd HH:mm:ss").alias("Time (UTC)"),
        F.col("endpoint").alias("Endpoint"),
        pct("bot_probability").alias("Bot Prob"),
        pct("image_risk_score").alias("Image Risk"),
        F.col("risk_level").alias("Risk Level"),
        shown("response_time_ms", "%.0f ms", F.bround("response_time_ms", 0)).alias("Response Time"),
        F.when(F.coalesce(F.col("error"), F.lit(0)) != 0, "Yes").otherwise("No").alias("Error"),
    )


def histogram(scores: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins on [0, 1]; the last bin is closed."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def flagged_share(scores: DataFrame, col: str = "bot_probability",
                  threshold: float = FLAG_THRESHOLD) -> DataFrame:
    return scores.agg(F.count_if(F.col(col) >= threshold).alias("flagged"),
                      F.count(F.lit(1)).alias("total"),
                      (F.count_if(F.col(col) >= threshold) / F.count(F.lit(1))).alias("share"))


def risk_share(breakdown: DataFrame) -> DataFrame:
    """Share of each level; the window runs over the few aggregated rows only."""
    return breakdown.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def stats_summary(calls: DataFrame, pings: DataFrame, as_of: str, digits=(4, 1)) -> DataFrame:
    """KPI row: one conditional aggregate per table plus two top-k means.

    Each part is a scalar subquery; Catalyst merges the ones over the same
    scan, so the call log is read once for both counts and the pings once
    for both figures.
    """
    lo, hi = day_bounds(as_of)
    if isinstance(calls, EventLog):     # the total is in the commits; only the day is scanned
        spark = calls.spark
        total, today = total_calls(calls), calls_today(calls, as_of)
    else:
        spark = calls.sparkSession
        total = today = ok(calls).agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.count_if(_ts_ge(lo) & _ts_lt(hi)).alias("calls_today"))
    pings = rows_of(pings)
    ping_counts = pings.agg(F.count_distinct("extension_id").alias("unique_installs"),
                            F.count(F.lit(1)).alias("total_pings"))
    bot = avg_bot_last(calls)
    rt = avg_rt_last(calls)
    return spark.range(1).select(
        total.select("total_calls").scalar().alias("total_calls"),
        today.select("calls_today").scalar().alias("calls_today"),
        or_zero(bot.scalar(), digits[0]).alias("avg_bot_probability"),
        or_zero(rt.scalar(), digits[1]).alias("avg_response_time_ms"),
        ping_counts.select("unique_installs").scalar().alias("unique_installs"),
        ping_counts.select("total_pings").scalar().alias("total_pings"),
    )


def stats_report(calls: DataFrame, pings: DataFrame, as_of: str, month_as_of: str | None = None,
                 digits=(4, 1)) -> DataFrame:
    """The whole statistics record as one row of 13 parts.

    The six figures of ``stats_summary``, the risk map, the daily, hourly and
    latency lists, the newest scores and the newest calls.  Every list is
    bounded by its window or limit before it is gathered.
    """
    def listed(df: DataFrame, order: str, *cols: str):
        row = F.struct(F.col(order).alias("o"), F.struct(*cols).alias("r"))
        rows = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])
        return df.agg(rows.alias("rows")).scalar()

    def newest(df: DataFrame, *cols: str):
        what = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
        row = F.struct(F.col("id").alias("o"), what.alias("r"))
        rows = F.transform(F.sort_array(F.collect_list(row), asc=False), lambda x: x["r"])
        return df.agg(rows.alias("rows")).scalar()

    levels = risk_breakdown(calls).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("risk_level", "count")))).alias("m")).scalar()
    recent = ("timestamp", "endpoint", "bot_probability", "image_risk_score", "risk_level",
              "response_time_ms", "error")
    return stats_summary(calls, pings, as_of, digits).select(
        "*", levels.alias("risk_breakdown"),
        listed(daily_calls(calls, month_as_of or as_of), "day", "day", "count").alias("daily_calls"),
        listed(hourly_calls(calls, as_of), "hour", "hour", "count").alias("hourly_calls"),
        newest(last_scores(calls, "bot_probability"), "bot_probability").alias("bot_probabilities"),
        newest(last_scores(calls, "image_risk_score"), "image_risk_score").alias("image_risk_scores"),
        newest(last_n(calls, LAST_CALLS, None, ("id", *recent)), *recent).alias("recent_calls"),
        listed(rt_trend(calls, as_of, digits=digits[1]), "hour", "hour", "avg_ms").alias("rt_trend"))


# ---- sinks: the log writers ----------------------------------------------------


def call_log_rows(scored: DataFrame, endpoint: str = "analyze_user") -> DataFrame:
    """Project scored rows to call-log rows (latency to 2 places, bool -> 0/1).

    ``id`` is the log's own: it grows with insertion.  It is taken from
    ``event_id`` where the caller has one; otherwise it holds the call's second
    in the upper bits and a hash of account, endpoint and time below, so a
    second call for an account gets a new id and newer calls sort later.
    ``append_log(..., number=True)`` replaces them by the log's own sequence.
    """
    def opt(c, t):
        return F.col(c) if c in scored.columns else F.lit(None).cast(t)
    when = F.col(TS) if TS in scored.columns else F.current_timestamp()
    own = F.shiftleft(F.unix_seconds(when.cast("timestamp")), 28).bitwiseOR(
        F.pmod(F.xxhash64("id", F.lit(endpoint), when), F.lit(1 << 28)))
    return scored.select(
        (F.col("event_id") if "event_id" in scored.columns else own).alias("id"),
        when.alias(TS),
        F.lit(endpoint).alias("endpoint"),
        F.round(F.col("response_time_ms"), 2).alias("response_time_ms"),
        opt("bot_probability", "double").alias("bot_probability"),
        opt("image_risk_score", "double").alias("image_risk_score"),
        opt("risk_level", "string").alias("risk_level"),
        F.col("is_bot").cast("int").alias("is_bot") if "is_bot" in scored.columns
        else F.lit(None).cast("int").alias("is_bot"),
        F.coalesce(opt("error", "boolean").cast("int"), F.lit(0)).alias("error"),
    )


def normalise_pings(raw: DataFrame) -> DataFrame:
    """``param or header or None`` for extension id and version."""
    def pick(a, b):
        return F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    return raw.select("id", TS, pick("extension_id", "hdr_extension_id").alias("extension_id"),
                      pick("version", "hdr_version").alias("version"))


def call_log(spark: SparkSession, path: str) -> EventLog:
    """The call log in a folder: batches once per token, rows checked against the schema."""
    return EventLog(spark, path, CALLS_SCHEMA, {name: c() for name, c in COUNTED.items()})


def ping_log(spark: SparkSession, path: str) -> EventLog:
    return EventLog(spark, path, PINGS_SCHEMA)


def _utc_clock(df: DataFrame) -> DataFrame:
    """Instants become the UTC wall clock that the log keeps (the session zone is UTC)."""
    if dict(df.dtypes)[TS] == "timestamp":
        return df.withColumn(TS, F.col(TS).cast("timestamp_ntz"))
    return df


def append_log(df: DataFrame, path: str, token: str | None = None, number: bool = False) -> bool:
    """Append calls to the day-partitioned log, once per ``token`` (a new one by default).

    ``number`` gives the rows ids that go on from the log's largest, by time.
    """
    log, rows = call_log(df.sparkSession, path), _utc_clock(df)
    return log.append(log.numbered(rows) if number else rows, token or uuid.uuid4().hex)


def append_pings(raw: DataFrame, path: str, token: str | None = None) -> bool:
    """Append normalised pings to the ping log, once per ``token``."""
    rows = _utc_clock(normalise_pings(raw))
    return ping_log(raw.sparkSession, path).append(rows, token or uuid.uuid4().hex)
