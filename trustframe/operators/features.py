"""Account feature engineering: 25 columns as one projection (no UDF).

The whole block is a single ``select`` so Catalyst fuses it with the scan
and whole-stage codegen evaluates it row by row in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clean_nonfinite, clip, safe_ratio
from ..schemas import BIN_BASE, FEATURES, LOG_COLS, NUM_BASE, RATIO_COLS, feature_list

RATIO_CLIP_HI = 1e6


def with_base_columns(df: DataFrame) -> DataFrame:
    """Absent base columns become constant 0; NULL cells of present columns stay."""
    missing = [c for c in NUM_BASE + BIN_BASE if c not in df.columns]
    if not missing:
        return df
    return df.withColumns({
        c: (F.lit(0.0) if c in NUM_BASE else F.lit(0)) for c in missing
    })


def _log1p_nonneg(x: Column) -> Column:
    # negatives clip to 0 first; NULL stays NULL (greatest() would turn it into 0)
    return F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x))


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """Column expressions of the 25 features over a frame with base columns."""
    c = {n: F.col(n) for n in NUM_BASE + BIN_BASE}
    age = c["account_age_days"]
    age_guard = F.when(age <= 0, F.lit(1.0)).otherwise(age)
    followers_p1 = c["followers_count"] + 1
    raw_ratios = {
        "followers_following_ratio": safe_ratio(c["followers_count"], c["following_count"]),
        "tweets_per_day": safe_ratio(c["tweet_count"], age_guard),
        "favourites_per_day": safe_ratio(c["favourites_count"], age_guard),
        "ff_log_ratio": safe_ratio(F.log1p(c["followers_count"]), F.log1p(c["following_count"])),
        "listed_per_1k_followers": F.lit(1000.0) * safe_ratio(c["listed_count"], followers_p1),
        "tweets_per_1k_followers": F.lit(1000.0) * safe_ratio(c["tweet_count"], followers_p1),
        "favourites_per_1k_followers": F.lit(1000.0) * safe_ratio(c["favourites_count"], followers_p1),
    }
    out: dict[str, Column] = {}
    for n in NUM_BASE:
        out[n] = c[n]
    for n in RATIO_COLS:
        # NaN/inf -> NULL -> 0 BEFORE the clip (Spark orders NaN above 1e6)
        out[n] = clip(F.coalesce(clean_nonfinite(raw_ratios[n]), F.lit(0.0)), 0.0, RATIO_CLIP_HI)
    for n, base in zip(LOG_COLS, NUM_BASE):
        out[n] = _log1p_nonneg(c[base])
    for n in BIN_BASE:
        out[n] = c[n]
    return out


def build_features(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Return ``keep`` columns followed by the 25 features in training order."""
    df = with_base_columns(df)
    exprs = feature_columns(df)
    return df.select(*[F.col(k) for k in keep], *[exprs[n].alias(n) for n in FEATURES])


def align_to_schema(df: DataFrame, columns: list[str] | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """Order by the training list; absent columns are filled with 0 (reindex)."""
    columns = columns or feature_list()
    have = set(df.columns)
    return df.select(*[F.col(k) for k in keep],
                     *[F.col(c) if c in have else F.lit(0.0).alias(c) for c in columns])
