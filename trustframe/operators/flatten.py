"""Nested account JSON (VARIANT) -> the flat 13-column account table.

Missing key and explicit null differ: ``try_variant_get(v, '$.k', 'variant')``
is SQL NULL only when the key is absent; an explicit JSON null is a
variant-null.  Defaults and key fallbacks apply to absent keys only, and the
truthiness rule is Python's: a non-empty string (even "False") is true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import account_age_days, text_present

ACCOUNT_COLUMNS = ("id", "followers_count", "following_count", "tweet_count", "listed_count",
                   "favourites_count", "account_age_days", "has_profile_image", "default_profile",
                   "has_description", "verified", "has_location", "has_url")


def field(obj, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "variant")


def absent(obj, key: str) -> Column:
    return field(obj, key).isNull()


def profile_of(obj) -> Column:
    """``obj.get('profile', obj)``."""
    return F.coalesce(field(obj, "profile"), obj)


def number(obj, key: str, default: Column | float = 0.0) -> Column:
    """Numeric field; default (or a fallback Column) only when the key is absent."""
    d = default if isinstance(default, Column) else F.lit(float(default))
    return F.when(absent(obj, key), d).otherwise(F.try_variant_get(obj, f"$.{key}", "double"))


def py_truthy(obj, key: str, default: bool) -> Column:
    """``bool(obj.get(key, default))`` with Python truthiness."""
    x = field(obj, key)
    kind = F.schema_of_variant(x)
    truth = (F.when(F.is_variant_null(x), F.lit(False))
             .when(kind == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
             .when(kind == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
             .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"),
                   F.length(F.to_json(x)) > 2)
             .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True))))
    return F.when(x.isNull(), F.lit(default)).otherwise(truth)


def text(obj, key: str) -> Column:
    return F.try_variant_get(obj, f"$.{key}", "string")


def flatten_accounts(unwrapped: DataFrame, as_of: str) -> DataFrame:
    """Project accepted account objects to the flat table (13 columns)."""
    o = F.col("obj")
    p = profile_of(o)
    fav_first = number(p, "favourites_count", number(p, "favorite_count"))
    return unwrapped.filter(o.isNotNull()).select(
        F.try_variant_get(o, "$.id", "string").alias("id"),
        number(p, "followers_count").alias("followers_count"),
        number(p, "friends_count").alias("following_count"),
        number(p, "statuses_count", number(p, "tweet_count")).alias("tweet_count"),
        number(p, "listed_count").alias("listed_count"),
        F.coalesce(fav_first, F.lit(0.0)).cast("bigint").cast("double").alias("favourites_count"),
        account_age_days(F.coalesce(text(p, "created_at"), F.lit("")), as_of).cast("double")
         .alias("account_age_days"),
        F.when(py_truthy(p, "default_profile_image", True), 0).otherwise(1).alias("has_profile_image"),
        F.when(py_truthy(p, "default_profile", True), 1).otherwise(0).alias("default_profile"),
        text_present(text(p, "description")).alias("has_description"),
        F.when(py_truthy(p, "verified", False), 1).otherwise(0).alias("verified"),
        text_present(text(p, "location")).alias("has_location"),
        text_present(text(p, "url")).alias("has_url"),
    )
