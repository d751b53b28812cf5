"""Registered queries: classifier metrics on the deterministic (label, score) table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import query, r6

PR_CTES = """
, hst AS (SELECT score, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                        CAST(SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg
          FROM label_score GROUP BY score)
, tot AS (SELECT CAST(SUM(pos) AS BIGINT) AS P, CAST(SUM(neg) AS BIGINT) AS N FROM hst)
, cum AS (SELECT score, pos, neg, CAST(SUM(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
                 CAST(SUM(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM hst)
, pr AS (SELECT c.*, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
                CASE WHEN t.P = 0 THEN 1e0 ELSE CAST(tp AS DOUBLE) / t.P END AS recall FROM cum c, tot t)
, f AS (SELECT *, 2e0 * precision * recall / (precision + recall + 1e-9) AS f1 FROM pr)
, best AS (SELECT score AS threshold, f1 FROM f ORDER BY f1 DESC, score ASC LIMIT 1)
, cm AS (SELECT COUNT(*) FILTER (WHERE label <> 1 AND score < threshold) AS tn,
                COUNT(*) FILTER (WHERE label <> 1 AND score >= threshold) AS fp,
                COUNT(*) FILTER (WHERE label = 1 AND score < threshold) AS fn,
                COUNT(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp
         FROM label_score, best)"""


def _m(name):
    return lambda body: query(name, with_fixtures(["label_score"], PR_CTES + "\n" + body))


def _ls(spark, sf_dir):
    return td.label_score(spark, sf_dir)


def _curve(spark, sf_dir):
    return M.pr_curve(_ls(spark, sf_dir))


@_m("pr_curve")("""SELECT score, pos, neg, tp, fp, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM f""")
def pr_curve(spark, sf_dir):
    c = _curve(spark, sf_dir)
    return c.select("score", "pos", "neg", "tp", "fp", *[r6(x).alias(x) for x in ("precision", "recall", "f1")])


@_m("best_threshold")("SELECT threshold, ROUND(f1, 6) AS f1 FROM best")
def best_threshold(spark, sf_dir):
    b = M.best_threshold(_curve(spark, sf_dir))
    return b.select("threshold", r6("f1").alias("f1"))


@_m("roc_auc")("""SELECT ROUND(SUM(CAST(neg AS DOUBLE) * (CAST(tp - pos AS DOUBLE) + pos / 2e0))
  / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) AS roc_auc FROM f""")
def roc_auc(spark, sf_dir):
    return M.roc_auc(_curve(spark, sf_dir)).select(r6("roc_auc").alias("roc_auc"))


@_m("average_precision")("""SELECT ROUND(SUM(pos * precision) / SUM(pos), 6) AS average_precision FROM f""")
def average_precision(spark, sf_dir):
    return M.average_precision(_curve(spark, sf_dir)).select(r6("average_precision").alias("average_precision"))


@_m("brier")("SELECT ROUND(AVG((score - label) * (score - label)), 6) AS brier FROM label_score")
def brier(spark, sf_dir):
    return M.brier(_ls(spark, sf_dir)).select(r6("brier").alias("brier"))


@_m("confusion_matrix")("SELECT tn, fp, fn, tp FROM cm")
def confusion_matrix(spark, sf_dir):
    ls = _ls(spark, sf_dir)
    th = M.best_threshold(M.pr_curve(ls)).select("threshold").scalar()
    return M.confusion(ls, th)


def _cls_sql(name, t, f_p, f_n, support):
    p = f"(CASE WHEN {t} + {f_p} = 0 THEN 0e0 ELSE CAST({t} AS DOUBLE) / ({t} + {f_p}) END)"
    r = f"(CASE WHEN {t} + {f_n} = 0 THEN 0e0 ELSE CAST({t} AS DOUBLE) / ({t} + {f_n}) END)"
    return (f"SELECT '{name}' AS class, {p} AS precision, {r} AS recall, "
            f"CASE WHEN {p} + {r} = 0 THEN 0e0 ELSE 2 * {p} * {r} / ({p} + {r}) END AS f1_score, "
            f"CAST({support} AS DOUBLE) AS support FROM cm")


@_m("classification_report")(f"""
, rep AS ({_cls_sql('Human', 'tn', 'fn', 'fp', 'tn + fp')} UNION ALL {_cls_sql('Bot', 'tp', 'fp', 'fn', 'tp + fn')})
, n AS (SELECT CAST(tn + fp + fn + tp AS DOUBLE) AS n, CAST(tn + tp AS DOUBLE) AS correct FROM cm)
, allrows AS (
  SELECT * FROM rep
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0e0 ELSE correct / n END, n FROM n
  UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1_score), (SELECT n FROM n) FROM rep
  UNION ALL SELECT 'weighted avg', SUM(precision * support) / (SELECT CASE WHEN n = 0 THEN 1 ELSE n END FROM n),
         SUM(recall * support) / (SELECT CASE WHEN n = 0 THEN 1 ELSE n END FROM n),
         SUM(f1_score * support) / (SELECT CASE WHEN n = 0 THEN 1 ELSE n END FROM n), (SELECT n FROM n) FROM rep)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1_score, 6) AS f1_score,
       support FROM allrows""")
def classification_report(spark, sf_dir):
    ls = _ls(spark, sf_dir)
    th = M.best_threshold(M.pr_curve(ls)).select("threshold").scalar()
    rep = M.classification_report(M.confusion(ls, th))
    return rep.select("class", *[r6(c).alias(c) for c in ("precision", "recall", "f1_score")], "support")
