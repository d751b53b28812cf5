"""Registered queries: scraped profile-page normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scraped as X
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import query

AS_OF = td.AS_OF_DAY
_CP = r"'^([0-9.]+)\s*([KkMm]?)$'"


def pc_sql(x: str) -> str:
    """DuckDB twin of ``parse_count``."""
    cl = rf"regexp_replace(regexp_replace(COALESCE({x}, ''), ',', '', 'g'), '^\s+|\s+$', '', 'g')"
    num = rf"TRY_CAST(regexp_extract(regexp_extract({cl}, {_CP}, 1), '^[0-9]*\.?[0-9]*', 0) AS DOUBLE)"
    mult = (f"CASE upper(regexp_extract({cl}, {_CP}, 2)) WHEN 'K' THEN 1000e0 "
            f"WHEN 'M' THEN 1000000e0 ELSE 1e0 END")
    return (f"(CASE WHEN regexp_matches({cl}, {_CP}) THEN CAST(FLOOR({num} * {mult} + 0.5) AS BIGINT) "
            f"ELSE 0 END)")


def first_pos_sql(items) -> str:
    whens = " ".join(f"WHEN {i} > 0 THEN {i}" for i in items)
    return f"(CASE {whens} ELSE 0 END)"


def _sp(spark, sf_dir):
    return td.scraped_profiles(spark, sf_dir)


def _q(name, fixtures, sql):
    return query(name, with_fixtures(fixtures, sql))


@_q("parse_count", ["scraped_profiles"], f"""SELECT id, followers_texts[1] AS text, {pc_sql('followers_texts[1]')} AS count
FROM scraped_profiles""")
def parse_count(spark, sf_dir):
    s = _sp(spark, sf_dir)
    t = F.get(F.col("followers_texts"), 0)
    return s.select("id", t.alias("text"), X.parse_count(t).alias("count"))


@_q("first_positive_count", ["scraped_profiles"], f"""SELECT id,
  {first_pos_sql([pc_sql(f'followers_texts[{i}]') for i in (1, 2, 3)])} AS followers_count,
  {first_pos_sql([pc_sql(f'following_texts[{i}]') for i in (1, 2)])} AS following_count
FROM scraped_profiles""")
def first_positive_count(spark, sf_dir):
    s = _sp(spark, sf_dir)
    return s.select("id", X.first_positive_count("followers_texts").alias("followers_count"),
                    X.first_positive_count("following_texts").alias("following_count"))


_EXCL = ", ".join(f"'{w}'" for w in X.PROFILE_EXCLUDED)
_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@_q("profile_urls", ["scraped_urls"], f"""SELECT page_id, len(parts) = 1 AND lower(parts[1]) NOT IN ({_EXCL}) AS is_profile,
  COALESCE(parts[1], '') AS handle
FROM (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts FROM scraped_urls) u""")
def profile_urls(spark, sf_dir):
    u = td.scraped_urls(spark, sf_dir)
    return u.select("page_id", X.is_profile_url("url").alias("is_profile"), X.profile_handle("url").alias("handle"))


@_q("avatar_url", ["scraped_profiles"], r"""SELECT id, regexp_replace(avatar_url, '_(normal|bigger|mini)\.', '_400x400.') AS profile_image_url,
  CASE WHEN COALESCE(contains(regexp_replace(avatar_url, '_(normal|bigger|mini)\.', '_400x400.'), 'pbs.twimg.com'), false)
       THEN 1 ELSE 0 END AS has_profile_image
FROM scraped_profiles""")
def avatar_url(spark, sf_dir):
    s = _sp(spark, sf_dir)
    u = X.upgrade_avatar("avatar_url")
    return s.select("id", u.alias("profile_image_url"), X.has_real_photo(u).alias("has_profile_image"))


@_q("scraped_flags", ["scraped_profiles"], r"""SELECT id,
  CASE WHEN length(regexp_replace(COALESCE(bio, ''), '^\s+|\s+$', '', 'g')) > 0 THEN 1 ELSE 0 END AS has_description,
  CASE WHEN location IS NOT NULL THEN 1 ELSE 0 END AS has_location,
  CASE WHEN url IS NOT NULL THEN 1 ELSE 0 END AS has_url,
  CASE WHEN badge IS NOT NULL THEN 1 ELSE 0 END AS verified,
  CASE WHEN banner IS NULL THEN 1 ELSE 0 END AS default_profile
FROM scraped_profiles""")
def scraped_flags(spark, sf_dir):
    a = X.assemble(_sp(spark, sf_dir), AS_OF)
    return a.select("id", "has_description", "has_location", "has_url", "verified", "default_profile")


_JP = r"'(?i)Joined\s+(\w+)\s+(\d{4})'"
_JOIN_SQL = rf"""
, j0 AS (SELECT id, regexp_extract(COALESCE(join_text, ''), {_JP}, 1) AS word,
                regexp_extract(COALESCE(join_text, ''), {_JP}, 2) AS yr FROM scraped_profiles)
, j1 AS (SELECT *, instr('{X.MONTH_PREFIXES}', lower(substr(word, 1, 3))) AS pos FROM j0)
, j2 AS (SELECT *, CASE WHEN length(word) >= 3 AND pos > 0 AND pos % 3 = 1 THEN CAST((pos + 2) / 3 AS INTEGER) END AS mon FROM j1)
, j3 AS (SELECT *, word <> '' AND mon IS NOT NULL AS valid,
    CAST(GREATEST(1, FLOOR((epoch(TIMESTAMP '{AS_OF}') - epoch(make_timestamp(TRY_CAST(yr AS INTEGER), mon, 1, 0, 0, 0))) / 86400e0 + 0.5)) AS BIGINT) AS age0
  FROM j2)
, j4 AS (SELECT id, word, yr, valid, CASE WHEN valid THEN age0 ELSE 365 END AS age FROM j3)"""


@_q("join_age", ["scraped_profiles"], _JOIN_SQL + """
SELECT id, age AS account_age_days,
  CASE WHEN NOT valid THEN '' WHEN age // 365 > 0
       THEN concat(word, ' ', yr, ' (', CAST(age // 365 AS VARCHAR), 'yr', CASE WHEN age // 365 > 1 THEN 's' ELSE '' END, ')')
       ELSE concat(word, ' ', yr) END AS join_display
FROM j4""")
def join_age(spark, sf_dir):
    s = _sp(spark, sf_dir)
    age, display = X.join_age("join_text", AS_OF)
    return s.select("id", age.alias("account_age_days"), display.alias("join_display"))


_PP = r"'(?i)([0-9,.]+[KkMm]?)\s+post'"


def _post_sql():
    items = [pc_sql(f"regexp_extract(aria_labels[{i}], {_PP}, 1)") for i in (1, 2, 3)]
    return first_pos_sql(items)


@_q("post_count", ["scraped_profiles"], f"SELECT id, {_post_sql()} AS post_count FROM scraped_profiles")
def post_count(spark, sf_dir):
    s = _sp(spark, sf_dir)
    return s.select("id", X.post_count("aria_labels").alias("post_count"))


@_q("impute_tweets", ["scraped_profiles"], f"""SELECT id, followers_count,
  CASE WHEN posts > 0 THEN posts WHEN followers_count > 10000 THEN 50000 WHEN followers_count > 1000 THEN 5000
       WHEN followers_count > 100 THEN 500 ELSE 50 END AS tweet_count,
  CAST(FLOOR(followers_count / 100e0 + 0.5) AS BIGINT) AS listed_count
FROM (SELECT id, {first_pos_sql([pc_sql(f'followers_texts[{i}]') for i in (1, 2, 3)])} AS followers_count,
             {_post_sql()} AS posts FROM scraped_profiles) x""")
def impute_tweets(spark, sf_dir):
    s = _sp(spark, sf_dir)
    f = X.first_positive_count("followers_texts")
    return s.select("id", f.alias("followers_count"),
                    X.impute_tweets(X.post_count("aria_labels"), f).alias("tweet_count"),
                    X.listed_estimate(f).alias("listed_count"))


_FOLLOWERS = first_pos_sql([pc_sql(f"followers_texts[{i}]") for i in (1, 2, 3)])
_FOLLOWING = first_pos_sql([pc_sql(f"following_texts[{i}]") for i in (1, 2)])


def _tenths(x: str) -> str:
    return f"printf('%.1f', FLOOR({x} * 10e0 + 0.5e0) / 10e0)"


@_q("format_count", ["scraped_profiles"], f"""SELECT id, f AS followers_count,
  CASE WHEN f >= 1000000 THEN {_tenths('f / 1000000e0')} || 'M' WHEN f >= 1000 THEN {_tenths('f / 1000e0')} || 'K'
       ELSE CAST(f AS VARCHAR) END AS followers_display
FROM (SELECT id, {_FOLLOWERS} AS f FROM scraped_profiles) x""")
def format_count(spark, sf_dir):
    s = _sp(spark, sf_dir)
    f = X.first_positive_count("followers_texts")
    return s.select("id", f.alias("followers_count"), X.format_count(f).alias("followers_display"))


@_q("scraped_accounts", ["scraped_profiles"], _JOIN_SQL + f"""
, c AS (SELECT *, {_FOLLOWERS} AS f, {_FOLLOWING} AS g, {_post_sql()} AS posts,
    regexp_replace(avatar_url, '_(normal|bigger|mini)\\.', '_400x400.') AS avatar FROM scraped_profiles)
SELECT c.id, CAST(f AS DOUBLE) AS followers_count, CAST(g AS DOUBLE) AS following_count,
  CAST(CASE WHEN posts > 0 THEN posts WHEN f > 10000 THEN 50000 WHEN f > 1000 THEN 5000
       WHEN f > 100 THEN 500 ELSE 50 END AS DOUBLE) AS tweet_count,
  CAST(FLOOR(f / 100e0 + 0.5) AS DOUBLE) AS listed_count, 0e0 AS favourites_count,
  CAST(age AS DOUBLE) AS account_age_days,
  CASE WHEN COALESCE(contains(avatar, 'pbs.twimg.com'), false) THEN 1 ELSE 0 END AS has_profile_image,
  CASE WHEN banner IS NULL THEN 1 ELSE 0 END AS default_profile,
  CASE WHEN length(regexp_replace(COALESCE(bio, ''), '^\\s+|\\s+$', '', 'g')) > 0 THEN 1 ELSE 0 END AS has_description,
  CASE WHEN badge IS NOT NULL THEN 1 ELSE 0 END AS verified,
  CASE WHEN location IS NOT NULL THEN 1 ELSE 0 END AS has_location,
  CASE WHEN url IS NOT NULL THEN 1 ELSE 0 END AS has_url,
  CASE WHEN NOT valid THEN '' WHEN age // 365 > 0
       THEN concat(word, ' ', yr, ' (', CAST(age // 365 AS VARCHAR), 'yr', CASE WHEN age // 365 > 1 THEN 's' ELSE '' END, ')')
       ELSE concat(word, ' ', yr) END AS join_display
FROM c JOIN j4 ON j4.id = c.id""".replace("\\\\", "\\"))
def scraped_accounts(spark, sf_dir):
    return X.assemble(_sp(spark, sf_dir), AS_OF)
