"""Domain tables derived from the driver's Parquet test data.

The test data is a TPC-H-like star schema plus ``events`` / ``documents`` /
``pages``.  The account-risk domain needs accounts, a scoring-call log,
extension pings, image signals, face detections and scraped profile fields;
each is derived here with plain DataFrame operations, so its size grows
with the scale factor.  The same derivations are written as SQL in
``plans/oracle.py`` for the DuckDB oracle.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---- fixed values of the derived fixtures ---------------------------------
ACCOUNT_AGE_EPOCH = "2002-01-01"      # account age = days from first order to this date
AS_OF_DAY = "2024-01-30 12:00:00"     # "now" for day and hour log windows
AS_OF_MONTH = "2024-02-10 12:00:00"   # "now" for the 30-day window
P_MULT = 7919                         # deterministic bot probability: id*7919 % 1000 / 1000
IMG_MULT = 104729                     # deterministic image risk: id*104729 % 1000 / 1000
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _grid(c: Column, mult: int) -> Column:
    return (c * mult % 1000).cast("double") / 1000


def probability_of(id_col: Column) -> Column:
    """The deterministic stand-in for a model's bot probability."""
    return _grid(id_col, P_MULT)


def image_risk_of(id_col: Column) -> Column:
    return _grid(id_col, IMG_MULT)


def listing(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of every file of a table: what a result kept for it depends on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(hadoop, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and line items per customer (pre-aggregated per order before the join)."""
    li = (table(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("li_n"), F.sum("l_quantity").alias("li_qty")))
    return (table(spark, sf_dir, "orders")
            .join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n_ord"),
                 F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_f"),
                 F.sum(F.coalesce("li_n", F.lit(0))).alias("n_li"),
                 F.sum(F.coalesce("li_qty", F.lit(0.0))).alias("qty"),
                 F.min(F.to_date("o_orderdate")).alias("first_day")))


def accounts(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None,
             totals: DataFrame | None = None) -> DataFrame:
    """B1: one account per customer (followers = orders, tweets = line items ...).

    Plan: line items are pre-aggregated per order (partial aggregation before
    the shuffle), joined to orders on the order key, aggregated per customer
    and joined to customers on the customer key; ``nation`` is a 25-row
    dimension and is broadcast by the optimiser's size check.
    """
    o = totals if totals is not None else order_totals(spark, sf_dir)
    cust = customers if customers is not None else table(spark, sf_dir, "customer")
    c = (cust
         .join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
         .join(o, F.col("o_custkey") == F.col("c_custkey"), "left"))
    k = F.col("c_custkey")
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    return c.select(
        k.alias("id"),
        F.coalesce("n_ord", F.lit(0)).cast("double").alias("followers_count"),
        F.col("c_nationkey").cast("double").alias("following_count"),
        F.coalesce("n_li", F.lit(0)).cast("double").alias("tweet_count"),
        F.coalesce("n_f", F.lit(0)).cast("double").alias("listed_count"),
        F.coalesce("qty", F.lit(0.0)).cast("double").alias("favourites_count"),
        F.coalesce(F.datediff(F.lit(ACCOUNT_AGE_EPOCH).cast("date"), F.col("first_day")),
                   F.lit(0)).cast("double").alias("account_age_days"),
        flag(k % 5 != 0).alias("has_profile_image"),
        flag(F.col("c_mktsegment") == "BUILDING").alias("default_profile"),
        flag(F.col("c_mktsegment") != "MACHINERY").alias("has_description"),
        flag(F.col("c_acctbal") > 9000).alias("verified"),
        flag(F.col("n_regionkey") != 0).alias("has_location"),
        flag(k % 3 == 0).alias("has_url"),
        flag(F.col("c_acctbal") < 2000).alias("label"),
    )


def scored_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a deterministic bot probability ``p`` and an optional image risk."""
    a = accounts(spark, sf_dir)
    return a.withColumns({
        "p": probability_of(F.col("id")),
        "img": F.when(F.col("id") % 4 == 0, F.lit(None).cast("double"))
                .otherwise(image_risk_of(F.col("id"))),
    })


def label_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) table for the metric operators."""
    return accounts(spark, sf_dir).select("id", "label", probability_of(F.col("id")).alias("score"))


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: scoring-call log derived from ``events``."""
    return calls_from_events(table(spark, sf_dir, "events"))


def calls_from_events(e: DataFrame) -> DataFrame:
    """Row-wise projection events -> call log (works on batch and streaming frames)."""
    eid, et = F.col("event_id"), F.col("event_type")
    user_call = et.isin("view", "click")
    image_call = et.isin("signup", "purchase")
    pk = eid * P_MULT % 1000
    ik = eid * IMG_MULT % 1000
    return e.select(
        eid.alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(image_call, F.lit("analyze_profile_image")).otherwise(F.lit("analyze_user")).alias("endpoint"),
        F.col("value").alias("response_time_ms"),
        F.when(user_call, pk.cast("double") / 1000).alias("bot_probability"),
        F.when(image_call, ik.cast("double") / 1000).alias("image_risk_score"),
        F.when(et == "error", F.lit(None).cast("string"))
         .when(user_call, F.when(pk >= 600, "High").when(pk >= 300, "Medium").otherwise("Low"))
         .otherwise(F.when(ik < 330, "low").when(ik < 660, "medium").otherwise("high")).alias("risk_level"),
        F.when(user_call, F.when(pk >= 300, 1).otherwise(0)).alias("is_bot"),
        F.when(et == "error", 1).otherwise(0).alias("error"),
    )


def extension_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: extension pings (one per signup event)."""
    return pings_from_events(table(spark, sf_dir, "events"))


def pings_from_events(e: DataFrame) -> DataFrame:
    e = e.filter(F.col("event_type") == "signup")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.when(u % 10 == 0, F.lit(None).cast("string")).otherwise(u.cast("string")).alias("extension_id"),
        F.when(u % 2 == 0, F.lit("1.0")).otherwise(F.lit("1.1")).alias("version"),
    )


def image_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: per-image quality signals (outputs of the pixel kernels)."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("image_id"),
        (F.lit(60) + d * 7 % 700).alias("width"),
        (F.lit(60) + d * 13 % 500).alias("height"),
        (d * 31 % 400).cast("double").alias("laplacian_variance"),
        ((d * 17 % 150).cast("double") / 1000).alias("compression_proxy"),
        ((d * 29 % 400).cast("double") / 1000).alias("edge_density"),
        (d * 37 % 6000).cast("double").alias("hsv_variance"),
    )


def face_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: 0-4 relative face boxes per image (outputs of the face detector).

    The k-th box exists when k < doc_id % 5; generated per row with a
    4-slot ``explode`` and a filter (no join needed).
    """
    d = F.col("doc_id")
    k = F.col("k")
    return (table(spark, sf_dir, "documents")
            .select(d, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
            .filter(k < d % 5)
            .select(
                d.alias("image_id"), k.cast("int").alias("det_id"),
                ((d * 3 + k * 19) % 80).cast("double") / 100 - 0.05,
                ((d * 5 + k * 23) % 80).cast("double") / 100 - 0.05,
                ((d + k * 11) % 50).cast("double") / 100,
                ((d * 2 + k * 7) % 50).cast("double") / 100,
                ((d * 11 + k * 41) % 100).cast("double") / 100,
            ).toDF("image_id", "det_id", "xmin", "ymin", "box_w", "box_h", "score"))


def scraped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7: page URLs, a third rewritten to profile-like and home URLs."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        p,
        F.when(p % 3 == 0, F.concat(F.lit("https://site.example/User"), p.cast("string")))
         .when(p % 3 == 1, F.lit("https://site.example/Home"))
         .otherwise(F.col("url")).alias("url"),
    )


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label file: human / bot / others per customer with a non-negative balance."""
    c = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 2000, "bot")
         .when(F.col("c_mktsegment") == "AUTOMOBILE", "others").otherwise("human").alias("label"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split file: train / val / test by nation."""
    n = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(n < 15, "train").when(n < 20, "val").otherwise("test").alias("split"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests: accounts shifted so that some counts/ages are invalid."""
    a = accounts(spark, sf_dir)
    i = F.col("id")
    return a.select(
        "id", (F.col("followers_count") - 3).alias("followers_count"), "following_count",
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("tweet_count")).alias("tweet_count"),
        "listed_count", (F.col("account_age_days") - 300).alias("account_age_days"),
        "has_profile_image", "has_description", "verified", "has_location", "has_url",
        F.when(i % 7 == 0, F.lit(None)).otherwise(F.col("favourites_count")).alias("favourites_count"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(F.col("default_profile")).alias("default_profile"),
    )


def profile_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw profile text fields (description, location, url, created_at) per customer."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k = F.col("c_custkey")
    ts = F.make_timestamp(F.lit(2006) + k % 20, F.lit(1) + k % 12, F.lit(1) + k % 28,
                          k % 24, k % 60, F.col("c_nationkey").cast("decimal(16,6)"))
    return c.select(
        k.alias("id"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("  \n ")).otherwise(F.col("c_name"))
         .alias("description"),
        F.when(F.col("n_regionkey") == 0, F.lit("")).otherwise(F.col("n_name")).alias("location"),
        F.when(F.col("c_acctbal") < 0, F.lit(None))
         .otherwise(F.concat(F.lit("https://example.com/"), k.cast("string"))).alias("url"),
        F.when(k % 5 == 0, F.date_format(ts, "EEE MMM dd HH:mm:ss '+0000' yyyy"))
         .when(k % 5 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+00:00'"))
         .when(k % 5 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
         .when(k % 5 == 3, F.lit(""))
         .otherwise(F.lit("not a date")).alias("created_at"),
    )


# ---- fixed values: month names of the generated join texts ------------------
MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")
# ---------------------------------------------------------------------------


def _count_text(k: Column, shift: int) -> Column:
    """Scraped count text in eight shapes (abbreviated, grouped, junk ...)."""
    v = (k + shift) % 8
    nat = F.col("c_nationkey").cast("string")
    return (F.when(v == 0, F.concat(nat, F.lit("."), (k % 10).cast("string"), F.lit("K")))
            .when(v == 1, F.concat(nat, F.lit("M")))
            .when(v == 2, F.concat(k.cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0")))
            .when(v == 3, F.lit("1.2.3"))
            .when(v == 4, F.concat((k % 50).cast("string"), F.lit(" k")))
            .when(v == 5, F.lit(""))
            .when(v == 6, F.col("c_mktsegment"))
            .otherwise(F.concat(nat, F.lit(".4B"))))


def scraped_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped profile-page fields per customer (display strings, as a page shows them)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), (k % 12 + 1).cast("int"))
    year = (F.lit(2006) + k % 18).cast("string")
    jv = k % 6
    join_text = (F.when(jv == 0, F.concat(F.lit("Joined "), month, F.lit(" "), year))
                 .when(jv == 1, F.concat(F.lit("joined "), F.substring(month, 1, 3), F.lit(" "), year))
                 .when(jv == 3, F.concat(F.lit("Joined Foo "), year))
                 .when(jv == 4, F.concat(F.lit("Joined "), F.lower(month), F.lit(" "), year))
                 .when(jv == 5, F.concat(F.lit("Member since "), year)))
    av = k % 4
    aria = F.array(
        F.concat(F.col("c_name"), F.lit(" profile")),
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(" posts")))
         .when(k % 4 == 1, F.concat(F.col("c_nationkey").cast("string"), F.lit(".5K Posts")))
         .when(k % 4 == 2, F.lit("0 posts"))
         .otherwise(F.concat((k % 7).cast("string"), F.lit(",100 posts"))),
        F.concat((k * 3).cast("string"), F.lit(" post")),
    )
    return c.select(
        k.alias("id"),
        F.array(_count_text(k, 0), _count_text(k, 3), _count_text(k, 5)).alias("followers_texts"),
        F.array(_count_text(k, 1), _count_text(k, 2)).alias("following_texts"),
        join_text.alias("join_text"),
        aria.alias("aria_labels"),
        F.when(av == 0, F.concat(F.lit("https://pbs.twimg.com/profile_images/"), k.cast("string"), F.lit("/a_normal.jpg")))
         .when(av == 1, F.concat(F.lit("https://pbs.twimg.com/profile_images/"), k.cast("string"),
                                 F.lit("/x_bigger_normal.png")))
         .when(av == 2, F.lit("https://abs.twimg.com/sticky/default_profile_images/default_profile_mini.png"))
         .alias("avatar_url"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("  \n ")).otherwise(F.col("c_name")).alias("bio"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("c_nationkey").cast("string")).alias("location"),
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.lit("example.com")).alias("url"),
        F.when(k % 9 == 0, F.lit("badge")).alias("badge"),
        F.when(k % 2 == 0, F.lit("banner")).alias("banner"),
    )


def raw_account_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw JSON element per account in six shapes (object, [id, obj], [obj],
    nested ``profile``, explicit nulls, junk), as an NDJSON dump would hold."""
    a = accounts(spark, sf_dir)
    t = profile_text(spark, sf_dir).select("id", "description", "location", "url", "created_at")
    j = a.join(t, "id")
    k = F.col("id")
    base = F.struct(
        k.alias("id"), F.col("followers_count").cast("bigint").alias("followers_count"),
        F.col("following_count").cast("bigint").alias("friends_count"),
        F.col("tweet_count").cast("bigint").alias("statuses_count"),
        F.col("listed_count").cast("bigint").alias("listed_count"),
        "description", "location", "url", "created_at",
        (F.col("verified") == 1).alias("verified"),
        (F.col("has_profile_image") == 0).alias("default_profile_image"),
        (F.col("default_profile") == 1).alias("default_profile"),
        F.col("favourites_count").alias("favourites_count"))
    alt = F.struct(
        k.alias("id"), F.col("followers_count").cast("bigint").alias("followers_count"),
        F.col("tweet_count").cast("bigint").alias("tweet_count"),
        F.when(F.col("verified") == 1, "True").otherwise("False").alias("verified"),
        F.col("favourites_count").alias("favorite_count"), "description")
    v = k % 6
    doc = (F.when(v == 0, F.to_json(base))
           .when(v == 1, F.concat(F.lit("["), k.cast("string"), F.lit(","), F.to_json(alt), F.lit("]")))
           .when(v == 2, F.concat(F.lit('[{"id":'), k.cast("string"), F.lit(',"profile":'), F.to_json(base),
                                  F.lit("}]")))
           .when(v == 3, F.lit("[1,2]"))
           .when(v == 4, F.concat(F.lit('{"id":'), k.cast("string"),
                                  F.lit(',"default_profile_image":null,"default_profile":null,"description":"  "}')))
           .otherwise(F.lit('"junk"')))
    return j.select(k.alias("idx"), F.try_parse_json(doc).alias("v"))
