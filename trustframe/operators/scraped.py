"""Normalisation of scraped profile-page fields into the account schema.

The browser-side string rules (abbreviated counts, URL classification,
avatar upgrade, join-date age, post counts and imputation) re-expressed as
Column functions, so a table of scraped pages is normalised in one
projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, js_round
from ..functions.text import strip_ws

# ---- fixed values ----------------------------------------------------------
COUNT_PATTERN = r"^([0-9.]+)\s*([KkMm]?)$"
POST_PATTERN = r"(?i)([0-9,.]+[KkMm]?)\s+post"
JOIN_PATTERN = r"(?i)Joined\s+(\w+)\s+(\d{4})"
AVATAR_PATTERN = r"_(normal|bigger|mini)\."
AVATAR_SIZE = "_400x400."
REAL_PHOTO_HOST = "pbs.twimg.com"
PROFILE_EXCLUDED = (
    "home", "explore", "notifications", "messages", "search", "settings",
    "compose", "about", "tos", "privacy", "rules", "i", "who_to_follow",
    "trending", "hashtag", "following", "followers",
)
MONTH_PREFIXES = "janfebmaraprmayjunjulaugsepoctnovdec"
DEFAULT_AGE_DAYS = 365
FOLLOWER_LADDER = ((10_000, 50_000), (1_000, 5_000), (100, 500))
LADDER_FLOOR = 50
# ---------------------------------------------------------------------------


def parse_count(text) -> Column:
    """'8.7K' -> 8700, '2M' -> 2000000, '1,234' -> 1234; no match -> 0.

    The number is read the way ``parseFloat`` does (longest leading decimal),
    so '1.2.3' gives 1; a lone '.' gives NULL (NaN in the original).
    """
    t = col(text)
    clean = strip_ws(F.regexp_replace(F.coalesce(t, F.lit("")), ",", ""))
    m = clean.rlike(COUNT_PATTERN)
    num_txt = F.regexp_extract(F.regexp_extract(clean, COUNT_PATTERN, 1), r"^[0-9]*\.?[0-9]*", 0)
    num = num_txt.try_cast("double")
    suffix = F.upper(F.regexp_extract(clean, COUNT_PATTERN, 2))
    mult = F.when(suffix == "K", F.lit(1000.0)).when(suffix == "M", F.lit(1_000_000.0)).otherwise(F.lit(1.0))
    return F.when(m, js_round(num * mult)).otherwise(F.lit(0)).cast("bigint")


def first_positive(counts) -> Column:
    """First element > 0 of an array of counts, else 0 (no out-of-bounds read)."""
    return F.coalesce(F.get(F.filter(col(counts), lambda x: x > 0), 0), F.lit(0)).cast("bigint")


def first_positive_count(texts) -> Column:
    return first_positive(F.transform(col(texts), parse_count))


def url_path(url) -> Column:
    return F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_parts(url) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda x: x != "")


def is_profile_url(url) -> Column:
    """Exactly one path segment that is not a reserved site section."""
    parts = path_parts(url)
    return (F.size(parts) == 1) & ~F.lower(F.get(parts, 0)).isin(*PROFILE_EXCLUDED)


def profile_handle(url) -> Column:
    return F.coalesce(F.get(path_parts(url), 0), F.lit(""))


def upgrade_avatar(url) -> Column:
    """Replace the first size suffix by the 400x400 one."""
    u = col(url)
    return F.regexp_replace(u, r"^(.*?)" + AVATAR_PATTERN, "$1" + AVATAR_SIZE)


def has_real_photo(url) -> Column:
    return F.when(F.coalesce(col(url).contains(REAL_PHOTO_HOST), F.lit(False)), 1).otherwise(0)


def _month_of(word: Column) -> Column:
    pos = F.instr(F.lit(MONTH_PREFIXES), F.lower(F.substring(word, 1, 3)))
    ok = (F.length(word) >= 3) & (pos > 0) & (pos % 3 == 1)
    return F.when(ok, ((pos + 2) / 3).cast("int"))


def join_age(text, as_of: str) -> tuple[Column, Column]:
    """(account_age_days, display) from 'Joined June 2018'; no match -> 365, ''."""
    t = F.coalesce(col(text), F.lit(""))
    word = F.regexp_extract(t, JOIN_PATTERN, 1)
    year_txt = F.regexp_extract(t, JOIN_PATTERN, 2)
    month = _month_of(word)
    d = F.make_timestamp(year_txt.try_cast("int"), month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(d)) / F.lit(86_400_000_000.0)
    age = F.greatest(F.lit(1), js_round(days).cast("bigint"))
    valid = (word != "") & month.isNotNull()
    age = F.when(valid, age).otherwise(F.lit(DEFAULT_AGE_DAYS).cast("bigint"))
    yrs = F.floor(age / 365)
    display = F.when(~valid, F.lit("")).when(
        yrs > 0, F.concat(word, F.lit(" "), year_txt, F.lit(" ("), yrs.cast("string"), F.lit("yr"),
                          F.when(yrs > 1, F.lit("s")).otherwise(F.lit("")), F.lit(")"))
    ).otherwise(F.concat(word, F.lit(" "), year_txt))
    return age, display


def post_count(labels) -> Column:
    """Count from the first label matching 'N posts' that gives a non-zero number."""
    return first_positive(F.transform(col(labels), lambda x: parse_count(F.regexp_extract(x, POST_PATTERN, 1))))


def impute_tweets(posts, followers) -> Column:
    f = col(followers)
    ladder = F.lit(LADDER_FLOOR)
    for lim, val in reversed(FOLLOWER_LADDER):
        ladder = F.when(f > lim, F.lit(val)).otherwise(ladder)
    return F.when(col(posts) > 0, col(posts)).otherwise(ladder).cast("bigint")


def listed_estimate(followers) -> Column:
    return js_round(col(followers) / 100).cast("bigint")


def format_count(n) -> Column:
    """1.2M / 3.4K / plain number for reports."""
    n = col(n)
    return (F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M")))
            .when(n >= 1_000, F.concat(F.format_string("%.1f", n / 1_000), F.lit("K")))
            .otherwise(n.cast("string")))


def assemble(df: DataFrame, as_of: str) -> DataFrame:
    """Scraped fields -> account schema (followers, following, posts, flags, age)."""
    followers = first_positive_count("followers_texts")
    following = first_positive_count("following_texts")
    age, display = join_age("join_text", as_of)
    posts = post_count("aria_labels")
    return df.select(
        "id",
        followers.cast("double").alias("followers_count"),
        following.cast("double").alias("following_count"),
        impute_tweets(posts, followers).cast("double").alias("tweet_count"),
        listed_estimate(followers).cast("double").alias("listed_count"),
        F.lit(0.0).alias("favourites_count"),
        age.cast("double").alias("account_age_days"),
        has_real_photo(upgrade_avatar("avatar_url")).alias("has_profile_image"),
        F.when(F.col("banner").isNull(), 1).otherwise(0).alias("default_profile"),
        F.when(F.length(strip_ws(F.coalesce("bio", F.lit("")))) > 0, 1).otherwise(0).alias("has_description"),
        F.when(F.col("badge").isNotNull(), 1).otherwise(0).alias("verified"),
        F.when(F.col("location").isNotNull(), 1).otherwise(0).alias("has_location"),
        F.when(F.col("url").isNotNull(), 1).otherwise(0).alias("has_url"),
        display.alias("join_display"),
    )
