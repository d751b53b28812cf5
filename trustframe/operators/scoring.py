"""Heuristic trust, ensemble blending, decisions and risk bands (Column exprs).

All functions return Columns (or add columns to a frame) so that a whole
scoring job stays one projection inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, col, gt, lt, py_num, truthy_num

# ---- fixed values: weights, thresholds and labels of the scoring rules -----
HEUR_BASE = 0.5
HEUR_AGE_1Y = 0.10          # age > 365 days
HEUR_AGE_2Y = 0.05          # age > 730 days
HEUR_PHOTO = 0.05
HEUR_DESCRIPTION = 0.05
HEUR_VERIFIED = 0.15
HEUR_NEW_SMALL = 0.15       # subtracted when age < 30 and followers < 20
W_BOT = 0.6
W_HEUR = 0.4
W_IMAGE_PENALTY = 0.15
TRUST_HIGH = 0.75
TRUST_MODERATE = 0.5
TRUST_LEVELS = ("High Trust", "Moderate Trust", "Low Trust")
COMBINE_W_BOT = 0.80
COMBINE_W_IMAGE = 0.20
DEFAULT_THRESHOLD = 0.30
HIGH_RISK = 0.60
RISK_LEVELS = ("High", "Medium", "Low")
PANEL_COLORS = ("red", "orange", "green", "grey")
BREAKDOWN_COMPONENTS = ("Bot Trust / 1−P(bot) (w=0.6)", "Heuristic Score (w=0.4)", "▶ Final Trust Score")
# ---------------------------------------------------------------------------


def _step(cond: Column, w: float) -> Column:
    return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))


def heuristic_score(followers="followers_count", age="account_age_days",
                    photo="has_profile_image", description="has_description",
                    verified="verified") -> Column:
    """Hand-written trust score in [0, 1].

    Terms are added left to right in the reference's order so that the
    double result is bit-identical; NULL numbers count as 0 and NaN compares
    false as in Python.
    """
    f = py_num(col(followers))
    a = py_num(col(age))
    s = (F.lit(HEUR_BASE)
         + _step(gt(a, 365), HEUR_AGE_1Y)
         + _step(gt(a, 730), HEUR_AGE_2Y)
         + _step(truthy_num(col(photo)), HEUR_PHOTO)
         + _step(truthy_num(col(description)), HEUR_DESCRIPTION)
         + _step(truthy_num(col(verified)), HEUR_VERIFIED)
         - _step(lt(a, 30) & lt(f, 20), HEUR_NEW_SMALL))
    return clamp01(s)


def trust_score_raw(p, heur, img=None) -> Column:
    """0.6*(1-p) + 0.4*heur - 0.15*img (img optional/NULL), clamped, unrounded."""
    s = F.lit(W_BOT) * (F.lit(1.0) - col(p)) + F.lit(W_HEUR) * col(heur)
    if img is not None:
        i = col(img)
        s = F.when(i.isNull(), s).otherwise(s - F.lit(W_IMAGE_PENALTY) * i)
    return clamp01(s)


def trust_level(score) -> Column:
    s = col(score)
    return (F.when(s >= TRUST_HIGH, F.lit(TRUST_LEVELS[0]))
            .when(s >= TRUST_MODERATE, F.lit(TRUST_LEVELS[1]))
            .otherwise(F.lit(TRUST_LEVELS[2])))


def ensemble_struct(p, heur, img=None, digits: int = 3) -> Column:
    """Nested ``ensemble`` record: trust_score (rounded), level, weights."""
    raw = trust_score_raw(p, heur, img)
    img_w = (F.when(col(img).isNull(), F.lit(0.0)).otherwise(F.lit(W_IMAGE_PENALTY))
             if img is not None else F.lit(0.0))
    return F.struct(
        F.round(raw, digits).alias("trust_score"),
        trust_level(raw).alias("trust_level"),
        F.struct(F.lit(W_BOT).alias("bot"), F.lit(W_HEUR).alias("heuristics"),
                 img_w.alias("image_risk")).alias("weights"),
    )


def combined_probability_raw(p, img) -> Column:
    """clamp(0.8p + 0.2img) when img is present, else p (unrounded)."""
    i = col(img)
    return F.when(i.isNull(), col(p)).otherwise(
        clamp01(F.lit(COMBINE_W_BOT) * col(p) + F.lit(COMBINE_W_IMAGE) * i))


def combined_probability(p, img, digits: int = 3) -> Column:
    i = col(img)
    return F.when(i.isNull(), col(p)).otherwise(F.round(combined_probability_raw(p, img), digits))


def is_bot(p, threshold: float | Column = DEFAULT_THRESHOLD) -> Column:
    return col(p) >= threshold


def risk_level(p, threshold: float | Column = DEFAULT_THRESHOLD, high: float = HIGH_RISK) -> Column:
    """High when p >= 0.60, Medium when p >= threshold, else Low (unrounded p)."""
    p = col(p)
    return (F.when(p >= high, F.lit(RISK_LEVELS[0]))
            .when(p >= threshold, F.lit(RISK_LEVELS[1]))
            .otherwise(F.lit(RISK_LEVELS[2])))


def risk_badge(p) -> Column:
    """Display band with strict comparisons (> 0.60, > 0.30)."""
    p = col(p)
    return (F.when(p > HIGH_RISK, F.lit("🔴 High"))
            .when(p > DEFAULT_THRESHOLD, F.lit("🟠 Medium"))
            .otherwise(F.lit("🟢 Low")))


def panel_color(p) -> Column:
    """Panel band with >= comparisons; grey when there is no score."""
    p = col(p)
    return (F.when(p.isNull(), F.lit(PANEL_COLORS[3]))
            .when(p >= HIGH_RISK, F.lit(PANEL_COLORS[0]))
            .when(p >= DEFAULT_THRESHOLD, F.lit(PANEL_COLORS[1]))
            .otherwise(F.lit(PANEL_COLORS[2])))


def shown_score(combined, raw) -> Column:
    """Score the panel shows: combined probability, else the raw one, else NULL."""
    return F.coalesce(col(combined), col(raw))


def user_result(p, threshold: float | Column = DEFAULT_THRESHOLD, digits: int = 3) -> Column:
    return F.struct(
        is_bot(p, threshold).alias("is_bot"),
        F.round(col(p), digits).alias("bot_probability"),
        risk_level(p, threshold).alias("risk_level"),
        (threshold if isinstance(threshold, Column) else F.lit(float(threshold))).alias("threshold_used"),
    )


def trust_breakdown(df: DataFrame, p="bot_probability", heur="heuristic_score",
                    trust="trust_score", keep=("id",)) -> DataFrame:
    """Long form: one row per component (1-p, heuristic, final trust).

    ``is_max`` marks the component(s) equal to the row maximum (what the
    report highlights); it is computed row-wise, so no shuffle is needed.
    """
    bot_trust = F.lit(1.0) - col(p)
    h = col(heur).cast("double")
    t = col(trust).cast("double")
    top = F.greatest(bot_trust, h, t)
    comps = F.array(*[
        F.struct(F.lit(name).alias("component"), F.lit(i).alias("ord"), v.alias("score"),
                 (v == top).alias("is_max"))
        for i, (name, v) in enumerate(zip(BREAKDOWN_COMPONENTS, (bot_trust, h, t)))
    ])
    return df.select(*keep, F.inline(comps))


def breakdown_max(breakdown: DataFrame) -> DataFrame:
    """Rows of the breakdown that hold the per-account maximum (ties all kept)."""
    return breakdown.filter(F.col("is_max")).drop("is_max")
