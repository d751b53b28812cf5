"""String and date Column helpers (Python/JS semantics re-expressed in SQL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


# fixed values: the characters Python's str.strip() removes
WHITE_SPACE = (r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
NOT_WHITE_SPACE = WHITE_SPACE.replace("[", "[^", 1)


def strip_ws(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(col(x), f"^{WHITE_SPACE}+|(?<!{WHITE_SPACE}){WHITE_SPACE}+$", "")


def text_present(x) -> Column:
    """``int((x or "").strip() != "")``."""
    return F.when(F.length(strip_ws(F.coalesce(col(x), F.lit("")))) > 0, 1).otherwise(0)


def whole_days_between(later, earlier) -> Column:
    """``(later - earlier).days`` (floor of the day difference) of two timestamps."""
    micros = F.unix_micros(col(later)) - F.unix_micros(col(earlier))
    return F.floor(micros / F.lit(86_400_000_000.0)).cast("bigint")


def parse_created_at(s) -> Column:
    """Account creation text -> TIMESTAMP, or NULL when unparseable.

    Tries the social-API form ``Wed Oct 10 20:19:24 +0000 2018`` first (the
    weekday word is cut, Spark's parser refuses the weekday letter), then
    ISO-8601 with or without offset (a naive value is read as UTC).  A year or
    a month alone is no date.
    """
    s = col(s)
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}.*)?$"), s)
    api = F.try_to_timestamp(F.substring(s, 5, 1 << 20), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(api, iso.try_cast("timestamp"))


def account_age_days(s, as_of: str) -> Column:
    """Whole days from creation to ``as_of``; 0 for empty, unparseable or future."""
    ts = parse_created_at(s)
    days = whole_days_between(F.lit(as_of).cast("timestamp"), ts)
    return F.when(ts.isNull(), F.lit(0)).otherwise(F.greatest(days, F.lit(0))).cast("bigint")
