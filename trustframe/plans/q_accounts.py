"""Registered queries: features, heuristic/ensemble scoring, risk bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators.features import build_features
from ..schemas import BIN_BASE, FEATURES, LOG_COLS, NUM_BASE, RATIO_COLS
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import query, r6

# --------------------------------------------------------------------------
# DuckDB twins of the feature expressions
# --------------------------------------------------------------------------


def _sr(a: str, b: str) -> str:
    return f"({a}) / (CASE WHEN ({b}) = 0 THEN 1 ELSE ({b}) END)"


_AGE = "(CASE WHEN account_age_days <= 0 THEN 1 ELSE account_age_days END)"
_RAW_RATIO_SQL = {
    "followers_following_ratio": _sr("followers_count", "following_count"),
    "tweets_per_day": _sr("tweet_count", _AGE),
    "favourites_per_day": _sr("favourites_count", _AGE),
    "ff_log_ratio": _sr("ln(1 + followers_count)", "ln(1 + following_count)"),
    "listed_per_1k_followers": "1000.0e0 * " + _sr("listed_count", "followers_count + 1"),
    "tweets_per_1k_followers": "1000.0e0 * " + _sr("tweet_count", "followers_count + 1"),
    "favourites_per_1k_followers": "1000.0e0 * " + _sr("favourites_count", "followers_count + 1"),
}


def _feature_sql(name: str) -> str:
    if name in NUM_BASE or name in BIN_BASE:
        return name
    if name in RATIO_COLS:
        x = _RAW_RATIO_SQL[name]
        return (f"LEAST(GREATEST(COALESCE(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END, 0), 0), 1e6)")
    base = name[len("log1p_"):]
    return f"ln(1 + CASE WHEN {base} < 0 THEN 0 ELSE {base} END)"


def _features_select(cols) -> str:
    out = []
    for c in cols:
        e = _feature_sql(c)
        out.append(f"{c}" if c in BIN_BASE else f"ROUND({e}, 6) AS {c}")
    return ", ".join(out)


HEUR_SQL = """LEAST(GREATEST(0.5e0
    + CASE WHEN COALESCE(account_age_days, 0) > 365 THEN 0.10e0 ELSE 0.0e0 END
    + CASE WHEN COALESCE(account_age_days, 0) > 730 THEN 0.05e0 ELSE 0.0e0 END
    + CASE WHEN COALESCE(has_profile_image, 0) <> 0 THEN 0.05e0 ELSE 0.0e0 END
    + CASE WHEN COALESCE(has_description, 0) <> 0 THEN 0.05e0 ELSE 0.0e0 END
    + CASE WHEN COALESCE(verified, 0) <> 0 THEN 0.15e0 ELSE 0.0e0 END
    - CASE WHEN COALESCE(account_age_days, 0) < 30 AND COALESCE(followers_count, 0) < 20 THEN 0.15e0 ELSE 0.0e0 END,
    0.0e0), 1.0e0)"""

TRUST_SQL = """LEAST(GREATEST(CASE WHEN img IS NULL THEN 0.6e0 * (1.0e0 - p) + 0.4e0 * heur
                   ELSE 0.6e0 * (1.0e0 - p) + 0.4e0 * heur - 0.15e0 * img END, 0.0e0), 1.0e0)"""

LEVEL_SQL = """CASE WHEN trust >= 0.75 THEN 'High Trust' WHEN trust >= 0.5 THEN 'Moderate Trust'
                    ELSE 'Low Trust' END"""

SCORED_BODY = f""", h AS (SELECT *, {HEUR_SQL} AS heur FROM scored),
t AS (SELECT *, {TRUST_SQL} AS trust FROM h)"""


def _scored_trust(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    s = s.withColumn("heur", S.heuristic_score())
    return s.withColumn("trust", S.trust_score_raw("p", "heur", "img"))


# --------------------------------------------------------------------------
# Flagship: accounts -> heuristic -> trust blend -> per trust level
# --------------------------------------------------------------------------


@query("trust_by_level", with_fixtures(["scored"], SCORED_BODY + f"""
SELECT {LEVEL_SQL} AS trust_level, COUNT(*) AS n_accounts,
       ROUND(AVG(trust), 6) AS avg_trust_score, ROUND(AVG(heur), 6) AS avg_heuristic_score
FROM t GROUP BY 1"""))
def trust_by_level(spark, sf_dir):
    t = _scored_trust(spark, sf_dir)
    return (t.groupBy(S.trust_level("trust").alias("trust_level"))
            .agg(F.count(F.lit(1)).alias("n_accounts"),
                 r6(F.avg("trust")).alias("avg_trust_score"),
                 r6(F.avg("heur")).alias("avg_heuristic_score")))


# --------------------------------------------------------------------------
# Features
# --------------------------------------------------------------------------


def _features_query(cols):
    def run(spark, sf_dir):
        f = build_features(td.accounts(spark, sf_dir), keep=("id",))
        return f.select("id", *[F.col(c) if c in BIN_BASE else r6(c).alias(c) for c in cols])
    return run


for _name, _cols in (("features_all", FEATURES), ("features_ratios", RATIO_COLS),
                     ("features_log1p", LOG_COLS)):
    query(_name, with_fixtures(["accounts"], f"SELECT id, {_features_select(_cols)} FROM accounts"))(
        _features_query(_cols))


# --------------------------------------------------------------------------
# Heuristic, trust, combined probability, risk bands
# --------------------------------------------------------------------------


@query("heuristic_score", with_fixtures(["accounts"], f"SELECT id, ROUND({HEUR_SQL}, 6) AS heuristic_score FROM accounts"))
def heuristic_score(spark, sf_dir):
    a = td.accounts(spark, sf_dir)
    return a.select("id", r6(S.heuristic_score()).alias("heuristic_score"))


@query("trust_score", with_fixtures(["scored"], SCORED_BODY + f"""
SELECT id, ROUND(trust, 6) AS trust_score, {LEVEL_SQL} AS trust_level,
       CASE WHEN img IS NULL THEN 0.0e0 ELSE 0.15e0 END AS image_weight FROM t"""))
def trust_score(spark, sf_dir):
    t = _scored_trust(spark, sf_dir)
    e = S.ensemble_struct("p", "heur", "img", digits=6)
    return t.select("id", e.alias("e")).select(
        "id", F.col("e.trust_score").alias("trust_score"), F.col("e.trust_level").alias("trust_level"),
        F.col("e.weights.image_risk").alias("image_weight"))


COMBINED_SQL = "CASE WHEN img IS NULL THEN p ELSE LEAST(GREATEST(0.8e0 * p + 0.2e0 * img, 0.0e0), 1.0e0) END"


@query("combined_probability", with_fixtures(["scored"], f"""
SELECT id, ROUND({COMBINED_SQL}, 6) AS combined_bot_probability FROM scored"""))
def combined_probability(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    return s.select("id", r6(S.combined_probability_raw("p", "img")).alias("combined_bot_probability"))


def _risk_sql(th: str) -> str:
    return f"""SELECT id, p >= {th} AS is_bot,
       CASE WHEN p >= 0.60 THEN 'High' WHEN p >= {th} THEN 'Medium' ELSE 'Low' END AS risk_level
FROM scored"""


# a learned threshold (E6) is a parameter; 0.45 stands in for one here
LEARNED_THRESHOLD = 0.45


@query("risk_level", with_fixtures(["scored"], _risk_sql("0.45")))
def risk_level(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    return s.select("id", S.is_bot("p", LEARNED_THRESHOLD).alias("is_bot"),
                    S.risk_level("p", LEARNED_THRESHOLD).alias("risk_level"))


@query("risk_level_fixed", with_fixtures(["scored"], _risk_sql("0.30")))
def risk_level_fixed(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    return s.select("id", S.is_bot("p").alias("is_bot"), S.risk_level("p").alias("risk_level"))


@query("risk_badge", with_fixtures(["scored"], f"""
SELECT id, CASE WHEN p > 0.60 THEN '🔴 High' WHEN p > 0.30 THEN '🟠 Medium' ELSE '🟢 Low' END AS badge,
       CASE WHEN c IS NULL THEN 'grey' WHEN c >= 0.60 THEN 'red' WHEN c >= 0.30 THEN 'orange' ELSE 'green' END AS panel_color
FROM (SELECT *, {COMBINED_SQL} AS c FROM scored) x"""))
def risk_badge(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    return s.select("id", S.risk_badge("p").alias("badge"),
                    S.panel_color(S.combined_probability_raw("p", "img")).alias("panel_color"))


_TOP = "GREATEST(1.0e0 - p, heur, trust) AS top FROM t"
_BREAKDOWN_SQL = SCORED_BODY + ", b AS (" + " UNION ALL ".join(
    f"SELECT id, '{name}' AS component, {i} AS ord, {value} AS score, {_TOP}"
    for i, (name, value) in enumerate(zip(S.BREAKDOWN_COMPONENTS, ("1.0e0 - p", "heur", "trust")))) + ")"


@query("trust_breakdown", with_fixtures(["scored"], _BREAKDOWN_SQL + """
SELECT id, component, ROUND(score, 6) AS score, score = top AS is_max FROM b"""))
def trust_breakdown(spark, sf_dir):
    t = _scored_trust(spark, sf_dir).withColumnRenamed("p", "bot_probability")
    b = S.trust_breakdown(t, "bot_probability", "heur", "trust")
    return b.select("id", "component", r6("score").alias("score"), "is_max")


@query("trust_breakdown_max", with_fixtures(["scored"], _BREAKDOWN_SQL + """
SELECT id, component, ROUND(score, 6) AS score FROM b WHERE score = top"""))
def trust_breakdown_max(spark, sf_dir):
    t = _scored_trust(spark, sf_dir).withColumnRenamed("p", "bot_probability")
    b = S.breakdown_max(S.trust_breakdown(t, "bot_probability", "heur", "trust"))
    return b.select("id", "component", r6("score").alias("score"))


@query("shown_score", with_fixtures(["scored"], f"""
SELECT id, ROUND(s, 6) AS shown_score,
       CASE WHEN s IS NULL THEN 'grey' WHEN s >= 0.60 THEN 'red' WHEN s >= 0.30 THEN 'orange' ELSE 'green' END AS panel_color
FROM (SELECT id, COALESCE(CASE WHEN id % 3 = 0 THEN NULL ELSE {COMBINED_SQL} END,
                          CASE WHEN id % 5 = 0 THEN NULL ELSE p END) AS s FROM scored) x"""))
def shown_score(spark, sf_dir):
    s = td.scored_accounts(spark, sf_dir)
    # the panel may lack either score: combined missing for every third id,
    # the raw one for every fifth
    comb = F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(S.combined_probability_raw("p", "img"))
    raw = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("p"))
    shown = S.shown_score(comb, raw)
    return s.select("id", r6(shown).alias("shown_score"), S.panel_color(shown).alias("panel_color"))
