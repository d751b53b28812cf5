"""Classifier evaluation from a ``(label, score)`` table.

Everything starts from the score histogram (one row per distinct score with
positive/negative counts, pre-aggregated map-side), so hot scores cost one
row each.  Running sums over the histogram use the parallel prefix sum in
``prefix.py``.  Single figures are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .prefix import running_sums

F1_EPS = 1e-9          # fixed value: added to P + R in the F1 of the threshold search
DEFAULT_CUT = 0.5      # fixed value: cut-off when no threshold is learned
CLASS_NAMES = ("Human", "Bot")


def score_histogram(ls: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return (ls.groupBy(F.col(score).alias("score"))
            .agg(F.count_if(F.col(label) == 1).alias("pos"),
                 F.count_if(F.col(label) == 0).alias("neg")))


def class_totals(hist: DataFrame) -> DataFrame:
    return hist.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))


def pr_curve(ls: DataFrame, label: str = "label", score: str = "score",
             n_buckets: int | None = None) -> DataFrame:
    """Per distinct score s: tp/fp of the rule ``score >= s``, precision, recall, F1."""
    h = materialize(score_histogram(ls, label, score))  # read three times below
    cum = running_sums(h, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    tot = class_totals(h)
    P = tot.select("P").scalar()
    tp, fp = F.col("tp"), F.col("fp")
    precision = tp.cast("double") / (tp + fp)
    recall = F.when(P == 0, F.lit(1.0)).otherwise(tp.cast("double") / P)
    return (cum.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"})
            .withColumns({"precision": precision, "recall": recall})
            .withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall")
                        / (F.col("precision") + F.col("recall") + F.lit(F1_EPS))))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Max-F1 threshold; the first maximum in ascending score order wins."""
    return curve.agg(F.min_by(F.struct("score", "f1"), F.struct(-F.col("f1"), F.col("score"))).alias("b")) \
        .select(F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid AUC (ties count 1/2) from the running sums; NULL with one class."""
    above = F.col("tp") - F.col("pos")
    num = F.sum(F.col("neg").cast("double") * (above.cast("double") + F.col("pos") / 2.0))
    P, N = F.sum("pos"), F.sum("neg")
    return curve.agg(F.when((P == 0) | (N == 0), F.lit(None).cast("double"))
                     .otherwise(num / (P.cast("double") * N)).alias("roc_auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    """Sum over thresholds of (R_n - R_{n-1}) * P_n; NULL with one class."""
    P, N = F.sum("pos"), F.sum("neg")
    return curve.agg(F.when((P == 0) | (N == 0), F.lit(None).cast("double"))
                     .otherwise(F.sum(F.col("pos") * F.col("precision")) / P).alias("average_precision"))


def brier(ls: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ls.agg(F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))


def confusion(ls: DataFrame, threshold: float | Column, label: str = "label",
              score: str = "score") -> DataFrame:
    pred = F.col(score) >= threshold
    y = F.col(label) == 1
    return ls.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
                  F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support, accuracy, macro and weighted means.

    Long form (one row per report line) built from the one-row confusion
    matrix; empty denominators give 0 as in the reference.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def cls(name, t, f_p, f_n, support):
        p = _div(t, t + f_p)
        r = _div(t, t + f_n)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        _div(2 * p * r, p + r).alias("f1_score"), support.cast("double").alias("support"))

    human = cls(CLASS_NAMES[0], tn, fn, fp, tn + fp)
    bot = cls(CLASS_NAMES[1], tp, fp, fn, tp + fn)
    rows = cm.select(human.alias("h"), bot.alias("b"), (tn + fp + fn + tp).cast("double").alias("n"),
                     (tn + tp).cast("double").alias("correct"))
    h, b, n = F.col("h"), F.col("b"), F.col("n")

    def avg_row(name, wh, wb, denom):
        return F.struct(F.lit(name).alias("class"),
                        ((h.precision * wh + b.precision * wb) / denom).alias("precision"),
                        ((h.recall * wh + b.recall * wb) / denom).alias("recall"),
                        ((h.f1_score * wh + b.f1_score * wb) / denom).alias("f1_score"),
                        n.alias("support"))
    acc = F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   _div(F.col("correct"), n).alias("f1_score"), n.alias("support"))
    return rows.select(F.inline(F.array(
        h, b, acc,
        avg_row("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0)),
        avg_row("weighted avg", h.support, b.support, F.when(n == 0, F.lit(1.0)).otherwise(n)),
    )))
