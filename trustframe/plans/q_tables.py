"""Registered queries: label joins, validation, text fields, statistics, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import account_age_days, text_present
from ..operators import labels as L
from ..operators import profilestats as P
from ..operators import sampling as M
from ..operators import validation as V
from ..operators.features import build_features
from ..schemas import FEATURES
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import query, r6
from .training import BASELINE_NUM

AS_OF = td.AS_OF_DAY


def _q(name, fixtures, sql):
    return query(name, with_fixtures(fixtures, sql))


# ---- joins and labels ------------------------------------------------------------

@_q("labelled_accounts", ["accounts", "raw_labels"], """SELECT a.id, a.followers_count, l.label
FROM accounts a JOIN raw_labels l ON l.id = a.id""")
def labelled_accounts(spark, sf_dir):
    j = L.join_labels(td.accounts(spark, sf_dir), td.raw_labels(spark, sf_dir))
    return j.select("id", "followers_count", "label")


@_q("train_split_semi", ["raw_labels", "splits"], """SELECT id, label FROM raw_labels
WHERE id IN (SELECT id FROM splits WHERE split = 'train')""")
def train_split_semi(spark, sf_dir):
    return L.train_labels(td.raw_labels(spark, sf_dir), td.splits(spark, sf_dir)).select("id", "label")


@_q("label_map", ["accounts", "raw_labels", "splits"], """SELECT a.id, CASE WHEN l.label = 'bot' THEN 1 ELSE 0 END AS label
FROM accounts a JOIN raw_labels l ON l.id = a.id
WHERE l.id IN (SELECT id FROM splits WHERE split = 'train') AND l.label IN ('human', 'bot')""")
def label_map(spark, sf_dir):
    lab = L.train_labels(td.raw_labels(spark, sf_dir), td.splits(spark, sf_dir))
    return L.map_labels(L.join_labels(td.accounts(spark, sf_dir), lab)).select("id", "label")


@_q("label_dropna", ["accounts", "raw_labels"], """SELECT a.id, l.label
FROM accounts a LEFT JOIN raw_labels l ON l.id = a.id WHERE l.label IS NOT NULL""")
def label_dropna(spark, sf_dir):
    a = td.accounts(spark, sf_dir).drop("label")
    j = a.join(td.raw_labels(spark, sf_dir), "id", "left")
    return L.drop_unlabelled(j).select("id", "label")


@_q("eda_label_counts", ["accounts", "raw_labels"], """SELECT l.label, COUNT(*) AS "count",
  CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS n_rows
FROM accounts a LEFT JOIN raw_labels l ON l.id = a.id GROUP BY l.label""")
def eda_label_counts(spark, sf_dir):
    a = td.accounts(spark, sf_dir).drop("label")
    j = a.join(td.raw_labels(spark, sf_dir), "id", "left")
    return P.label_counts(j)


def _describe_sql():
    feats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATURES)
    from .q_accounts import _features_select
    return f"""
, f AS (SELECT id, {_features_select(FEATURES).replace('ROUND(', 'ROUND((').replace(', 6) AS', '), 12) AS')} FROM accounts)
, g AS (SELECT id, {feats} FROM f)
, u AS (UNPIVOT g ON {", ".join(FEATURES)} INTO NAME feature VALUE value)
SELECT feature, COUNT(value) AS "count", ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std,
  ROUND(MIN(value), 6) AS min, ROUND(quantile_cont(value, 0.1), 6) AS p10,
  ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.9), 6) AS p90,
  ROUND(MAX(value), 6) AS max
FROM u GROUP BY feature"""


@_q("eda_describe", ["accounts"], _describe_sql())
def eda_describe(spark, sf_dir):
    f = build_features(td.accounts(spark, sf_dir), keep=("id",))
    d = P.describe(f.select("id", *[F.round(F.col(c).cast("double"), 12).alias(c) for c in FEATURES]),
                   FEATURES)
    return d.select("feature", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "p10", "p50", "p90", "max")])


# ---- validation --------------------------------------------------------------------

_REQ = " OR ".join(f"{c} IS NULL" for c in V.REQUIRED)
_VALIDATE_SQL = f"""
, v AS (SELECT id, COALESCE(favourites_count, 0e0) AS favourites_count, COALESCE(default_profile, 0) AS default_profile,
  CASE WHEN {_REQ} THEN '{V.MSG_MISSING}'
       WHEN followers_count < 0 OR following_count < 0 OR tweet_count < 0 THEN '{V.MSG_NEGATIVE}'
       WHEN account_age_days <= 0 THEN '{V.MSG_AGE}' END AS reject_reason FROM requests)"""


@_q("validate_accounts", ["requests"], _VALIDATE_SQL + """
SELECT id, favourites_count, default_profile, reject_reason,
  CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status FROM v""")
def validate_accounts(spark, sf_dir):
    v = V.validate_accounts(td.requests(spark, sf_dir))
    return v.select("id", "favourites_count", "default_profile", "reject_reason", "status")


@_q("validation_counts", ["requests"], _VALIDATE_SQL + """
SELECT CASE WHEN reject_reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reject_reason,
  COUNT(*) AS "count" FROM v GROUP BY 1, 2""")
def validation_counts(spark, sf_dir):
    v = V.validate_accounts(td.requests(spark, sf_dir))
    return v.groupBy("status", "reject_reason").agg(F.count(F.lit(1)).alias("count"))


@_q("validate_text", [], r"""SELECT doc_id, length(regexp_replace(COALESCE(text, ''), '^\s+|\s+$', '', 'g')) > 0 AS is_valid
FROM documents""")
def validate_text(spark, sf_dir):
    d = V.validate_text(td.table(spark, sf_dir, "documents"))
    return d.select("doc_id", "is_valid")


# ---- raw text fields -----------------------------------------------------------------

def _present_sql(c):
    return (rf"CASE WHEN length(regexp_replace(COALESCE({c}, ''), '^\s+|\s+$', '', 'g')) > 0 "
            f"THEN 1 ELSE 0 END AS has_{c}")


@_q("text_presence_flags", ["profile_text"], f"""SELECT id, {_present_sql('description')},
  {_present_sql('location')}, {_present_sql('url')} FROM profile_text""")
def text_presence_flags(spark, sf_dir):
    t = td.profile_text(spark, sf_dir)
    return t.select("id", *[text_present(c).alias(f"has_{c}") for c in ("description", "location", "url")])


@_q("account_age_days", ["profile_text"], f"""SELECT id, CAST(CASE WHEN e IS NULL THEN 0
  ELSE GREATEST(FLOOR((epoch(TIMESTAMP '{AS_OF}') - e) / 86400), 0) END AS BIGINT) AS account_age_days
FROM (SELECT id, COALESCE(epoch(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y')),
                          epoch(try_strptime(created_at, '%Y-%m-%d %H:%M:%S%z')),
                          epoch(try_strptime(created_at, '%Y-%m-%dT%H:%M:%S'))) AS e FROM profile_text) x""")
def account_age_days_q(spark, sf_dir):
    t = td.profile_text(spark, sf_dir)
    return t.select("id", account_age_days("created_at", AS_OF).alias("account_age_days"))


# ---- class balance, weights, scaling ---------------------------------------------------

@_q("class_balance", ["accounts"], """SELECT COUNT(*) FILTER (WHERE label = 0) AS n_human,
  COUNT(*) FILTER (WHERE label = 1) AS n_bot,
  ROUND(CAST(COUNT(*) FILTER (WHERE label = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE label = 1), 6) AS imbalance_ratio
FROM accounts""")
def class_balance(spark, sf_dir):
    b = M.class_balance(td.accounts(spark, sf_dir))
    return b.select("n_human", "n_bot", r6("imbalance_ratio").alias("imbalance_ratio"))


@_q("class_weights", ["accounts"], """SELECT label, n_c, ROUND(SUM(n_c) OVER () / (COUNT(*) OVER () * n_c), 6) AS weight
FROM (SELECT label, COUNT(*) AS n_c FROM accounts GROUP BY label) x""")
def class_weights(spark, sf_dir):
    w = M.class_weights(td.accounts(spark, sf_dir))
    return w.select("label", "n_c", r6("weight").alias("weight"))


SCALE_COLS = BASELINE_NUM


def _scale_sql():
    from .q_accounts import _feature_sql
    base = ", ".join(f"{_feature_sql(c)} AS {c}" for c in SCALE_COLS)
    outs = ", ".join(
        f"ROUND(({c} - AVG({c}) OVER ()) / CASE WHEN STDDEV_POP({c}) OVER () = 0 THEN 1 "
        f"ELSE STDDEV_POP({c}) OVER () END, 6) AS {c}" for c in SCALE_COLS)
    return f", s AS (SELECT id, {base} FROM accounts)\nSELECT id, {outs} FROM s"


@_q("standard_scale", ["accounts"], _scale_sql())
def standard_scale(spark, sf_dir):
    f = build_features(td.accounts(spark, sf_dir), keep=("id",)).select("id", *SCALE_COLS)
    params = M.fit_standard_scaler(f, SCALE_COLS)
    s = M.standard_scale(f, params)
    return s.select("id", *[r6(c).alias(c) for c in SCALE_COLS])


# ---- samples, splits, folds (rows-only) ---------------------------------------------------

@_q("balanced_sample", ["accounts"], "SELECT * FROM accounts")
def balanced_sample(spark, sf_dir):
    """The check tables are within the caps: every row stays (smaller caps: see below)."""
    return M.balanced_sample(td.accounts(spark, sf_dir))


@_q("capped_sample_counts", ["accounts"], """SELECT label, CAST(LEAST(COUNT(*), CASE WHEN label = 1 THEN 20 ELSE 40 END) AS BIGINT) AS n
FROM accounts GROUP BY label""")
def capped_sample_counts(spark, sf_dir):
    """Caps that bind at every scale."""
    s = M.balanced_sample(td.accounts(spark, sf_dir), caps={1: 20, 0: 40})
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@_q("split_shares", ["accounts"], """SELECT part, label, CAST(CASE WHEN part = 'test' THEN t ELSE n - t END AS BIGINT) AS n
FROM (SELECT label, COUNT(*) AS n, round_even(COUNT(*) * 0.2, 0) AS t FROM accounts GROUP BY label) c
CROSS JOIN (VALUES ('train'), ('test')) p(part)""")
def split_shares(spark, sf_dir):
    train, test = M.stratified_split(td.accounts(spark, sf_dir))
    return (train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
            .groupBy("part", "label").agg(F.count(F.lit(1)).alias("n")))


@_q("fold_sizes", ["accounts"], """SELECT CAST(fold AS INTEGER) AS fold, label,
  CAST(n // 3 + CASE WHEN fold < n % 3 THEN 1 ELSE 0 END AS BIGINT) AS n
FROM (SELECT label, COUNT(*) AS n FROM accounts GROUP BY label) c CROSS JOIN (VALUES (0), (1), (2)) f(fold)""")
def fold_sizes(spark, sf_dir):
    a = td.accounts(spark, sf_dir)
    return M.fold_column(a, 3).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@_q("impute_median", ["requests"], """SELECT id,
  ROUND(COALESCE(CAST(tweet_count AS DOUBLE), (SELECT quantile_cont(CAST(tweet_count AS DOUBLE), 0.5) FROM requests)), 6) AS tweet_count,
  ROUND(COALESCE(CAST(favourites_count AS DOUBLE), (SELECT quantile_cont(CAST(favourites_count AS DOUBLE), 0.5) FROM requests)), 6)
    AS favourites_count
FROM requests""")
def impute_median(spark, sf_dir):
    r = td.requests(spark, sf_dir)
    filled = M.impute_median(r, ["tweet_count", "favourites_count"])
    return filled.select("id", r6("tweet_count").alias("tweet_count"), r6("favourites_count").alias("favourites_count"))


# ---- raw JSON flattening (rows-only; VARIANT has no DuckDB twin) -------------------------

@query("flatten_accounts")
def flatten_accounts(spark, sf_dir):
    from ..operators.flatten import flatten_accounts as flat
    from ..sources.raw_json import unwrap_accounts
    return flat(unwrap_accounts(td.raw_account_json(spark, sf_dir)), AS_OF)


@query("rejected_raw")
def rejected_raw(spark, sf_dir):
    from ..sources.raw_json import rejected_raw as rej
    from ..sources.raw_json import unwrap_accounts
    return rej(unwrap_accounts(td.raw_account_json(spark, sf_dir)))
