"""Request validation as row routing: accepted / rejected with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_WHITE_SPACE

# ---- fixed values: required inputs, defaults and messages -------------------
REQUIRED = ("followers_count", "following_count", "tweet_count", "listed_count", "account_age_days",
            "has_profile_image", "has_description", "verified", "has_location", "has_url")
DEFAULTS = {"favourites_count": 0.0, "default_profile": 0}
MSG_MISSING = "Missing required field."
MSG_NEGATIVE = "Counts (followers, following, tweets) cannot be negative."
MSG_AGE = "Account age must be a positive number of days."
MSG_EMPTY_TEXT = "Text cannot be empty."
# ---------------------------------------------------------------------------


def validate_accounts(df: DataFrame) -> DataFrame:
    """Add ``reject_reason`` (NULL when valid) and ``status``; fill optional defaults.

    Order of checks: required fields, negative counts (followers, following,
    tweets only), then age <= 0.
    """
    missing = None
    for c in REQUIRED:
        cond = F.col(c).isNull() if c in df.columns else F.lit(True)
        missing = cond if missing is None else (missing | cond)
    negative = (F.col("followers_count") < 0) | (F.col("following_count") < 0) | (F.col("tweet_count") < 0)
    reason = (F.when(missing, F.lit(MSG_MISSING))
              .when(negative, F.lit(MSG_NEGATIVE))
              .when(F.col("account_age_days") <= 0, F.lit(MSG_AGE)))
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)
                          for c, v in DEFAULTS.items()})
    return out.withColumn("reject_reason", reason).withColumn(
        "status", F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected tables (rejects keep their reason)."""
    return (validated.filter(F.col("status") == "accepted").drop("reject_reason"),
            validated.filter(F.col("status") == "rejected"))


def validate_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Blank: no character that ``strip_ws`` leaves; the search ends at the first one."""
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(NOT_WHITE_SPACE)
    return df.withColumns({"is_valid": ~blank,
                           "reject_reason": F.when(blank, F.lit(MSG_EMPTY_TEXT))})
