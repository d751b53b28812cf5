"""Schemas and the fixed feature vocabulary (single source of truth)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: names of the account inputs and derived features -------
NUM_BASE = (
    "followers_count", "following_count", "tweet_count", "listed_count",
    "favourites_count", "account_age_days",
)
BIN_BASE = (
    "has_profile_image", "default_profile", "has_description",
    "verified", "has_location", "has_url",
)
RATIO_COLS = (
    "followers_following_ratio", "tweets_per_day", "favourites_per_day",
    "ff_log_ratio", "listed_per_1k_followers", "tweets_per_1k_followers",
    "favourites_per_1k_followers",
)
LOG_COLS = tuple(f"log1p_{c}" for c in NUM_BASE)
# final order: 6 base numerics, 7 ratios, 6 logs, 6 flags
FEATURES = NUM_BASE + RATIO_COLS + LOG_COLS + BIN_BASE
# ---------------------------------------------------------------------------


def feature_list() -> list[str]:
    """The 25 model inputs in training order."""
    return list(FEATURES)


ACCOUNTS_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType(), True)]      # ids are text ("u123")
    + [T.StructField(c, T.DoubleType(), True) for c in NUM_BASE]
    + [T.StructField(c, T.IntegerType(), True) for c in BIN_BASE]
    + [T.StructField("label", T.IntegerType(), True)]
)

LABELS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
])

SPLIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("split", T.StringType(), True),
])

# Event-log tables (append-only; written partitioned by UTC day, whose wall clock the time stamps are).
CALLS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("endpoint", T.StringType(), False),
    T.StructField("response_time_ms", T.DoubleType(), True),
    T.StructField("bot_probability", T.DoubleType(), True),
    T.StructField("image_risk_score", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
    T.StructField("is_bot", T.IntegerType(), True),
    T.StructField("error", T.IntegerType(), False),
])

PINGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("extension_id", T.StringType(), True),
    T.StructField("version", T.StringType(), True),
])

IMAGE_SIGNALS_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("width", T.LongType(), False),
    T.StructField("height", T.LongType(), False),
    T.StructField("laplacian_variance", T.DoubleType(), True),
    T.StructField("compression_proxy", T.DoubleType(), True),
    T.StructField("edge_density", T.DoubleType(), True),
    T.StructField("hsv_variance", T.DoubleType(), True),
])

FACE_DETECTIONS_SCHEMA = T.StructType([
    T.StructField("image_id", T.LongType(), False),
    T.StructField("det_id", T.LongType(), False),
    T.StructField("xmin", T.DoubleType(), True),
    T.StructField("ymin", T.DoubleType(), True),
    T.StructField("box_w", T.DoubleType(), True),
    T.StructField("box_h", T.DoubleType(), True),
    T.StructField("score", T.DoubleType(), True),
])
