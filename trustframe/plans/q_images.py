"""Registered queries: image-risk scoring over signal and detection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as I
from ..sources import testdata as td
from .oracle_fixtures import with_fixtures
from .registry import query, r6


def _clamp(x: str) -> str:
    return f"LEAST(GREATEST({x}, 0e0), 1e0)"


_M = "GREATEST(width, height)"
IMAGE_CTES = f"""
, dims AS (SELECT image_id,
    CASE WHEN {_M} > 512 THEN CAST(TRUNC(width * (512e0 / {_M})) AS BIGINT) ELSE width END AS width,
    CASE WHEN {_M} > 512 THEN CAST(TRUNC(height * (512e0 / {_M})) AS BIGINT) ELSE height END AS height,
    laplacian_variance, compression_proxy, edge_density, hsv_variance FROM image_signals)
, boxes AS (SELECT * FROM (SELECT f.image_id, f.det_id,
    CAST(TRUNC(GREATEST(0e0, f.xmin * d.width)) AS BIGINT) AS x1,
    CAST(TRUNC(GREATEST(0e0, f.ymin * d.height)) AS BIGINT) AS y1,
    CAST(TRUNC(LEAST(CAST(d.width AS DOUBLE), (f.xmin + f.box_w) * d.width)) AS BIGINT) AS x2,
    CAST(TRUNC(LEAST(CAST(d.height AS DOUBLE), (f.ymin + f.box_h) * d.height)) AS BIGINT) AS y2,
    f.score, d.width AS w, d.height AS h
  FROM face_detections f JOIN dims d ON d.image_id = f.image_id) z WHERE x2 > x1 AND y2 > y1)
, fs AS (SELECT image_id, COUNT(*) AS num_faces,
    MAX(CASE WHEN rn = 1 THEN CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / (w * h) END) AS face_area_ratio
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rn FROM boxes) q
  GROUP BY image_id)
, comp AS (SELECT d.*, COALESCE(fs.num_faces, 0) AS num_faces, COALESCE(fs.face_area_ratio, 0e0) AS face_area_ratio,
    LEAST(d.width, d.height) AS min_side,
    {_clamp("(200e0 - laplacian_variance) / 200e0")} AS blur_risk,
    {_clamp("compression_proxy / 0.12e0")} AS compression_risk,
    {_clamp("ABS(edge_density - 0.10e0) / 0.25e0")} AS edge_risk,
    LEAST(1e0, hsv_variance / 5000e0) AS color_variance_norm,
    {_clamp("1e0 - LEAST(1e0, hsv_variance / 5000e0)")} AS color_risk,
    CASE WHEN LEAST(d.width, d.height) < 96 THEN 1.0e0 WHEN LEAST(d.width, d.height) < 128 THEN 0.6e0
         WHEN LEAST(d.width, d.height) < 160 THEN 0.3e0 ELSE 0.0e0 END AS resolution_risk,
    CASE WHEN COALESCE(fs.num_faces, 0) >= 3 THEN 0.6e0 WHEN COALESCE(fs.num_faces, 0) = 2 THEN 0.3e0 ELSE 0.0e0 END AS multi_face_risk,
    CASE WHEN COALESCE(fs.num_faces, 0) > 0 THEN 0.0e0 ELSE 1.0e0 END AS no_face_risk
  FROM dims d LEFT JOIN fs ON fs.image_id = d.image_id)
, risk AS (SELECT *, {_clamp('''0.30e0 * no_face_risk + 0.15e0 * resolution_risk + 0.15e0 * blur_risk
    + 0.10e0 * compression_risk + 0.10e0 * edge_risk + 0.10e0 * color_risk + 0.05e0 * multi_face_risk
    + 0.05e0 * ''' + _clamp("face_area_ratio * 3"))} AS score FROM comp)
, lvl AS (SELECT *, CASE WHEN score < 0.33 THEN 'low' WHEN score < 0.66 THEN 'medium' ELSE 'high' END AS risk_level FROM risk)"""

IMG_FX = ["image_signals", "face_detections"]


def _img(names=()):
    return lambda body: query(names, with_fixtures(IMG_FX, IMAGE_CTES + "\n" + body))


def _risk(spark, sf_dir):
    return I.image_risk(td.image_signals(spark, sf_dir), td.face_detections(spark, sf_dir))


def _boxes(spark, sf_dir):
    s = td.image_signals(spark, sf_dir)
    return I.face_boxes(td.face_detections(spark, sf_dir), I.resized_dims(s))


@_img("image_resize_dims")("SELECT image_id, width, height FROM dims")
def image_resize_dims(spark, sf_dir):
    return I.resized_dims(td.image_signals(spark, sf_dir)).select("image_id", "width", "height")


@_img("face_boxes")("SELECT image_id, det_id, x1, y1, x2, y2, ROUND(score, 6) AS score FROM boxes")
def face_boxes(spark, sf_dir):
    return _boxes(spark, sf_dir).select("image_id", "det_id", "x1", "y1", "x2", "y2", r6("score").alias("score"))


@_img("face_stats")("""SELECT image_id, num_faces, num_faces > 0 AS face_detected,
  ROUND(face_area_ratio, 6) AS face_area_ratio FROM comp""")
def face_stats(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return r.select("image_id", "num_faces", "face_detected", r6("face_area_ratio").alias("face_area_ratio"))


_COMPONENTS = ("blur_risk", "compression_risk", "edge_risk", "color_risk", "resolution_risk",
               "multi_face_risk", "no_face_risk")


@_img("image_component_risks")("SELECT image_id, min_side, " + ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in _COMPONENTS) + " FROM comp")
def image_component_risks(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return r.select("image_id", "min_side", *[r6(c).alias(c) for c in _COMPONENTS])


@_img("image_risk")("SELECT image_id, ROUND(score, 6) AS image_risk_score, risk_level FROM lvl")
def image_risk(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return r.select("image_id", r6("score").alias("image_risk_score"), "risk_level")


@_img("image_notes")("""SELECT image_id, concat_ws(' | ',
    CASE WHEN num_faces = 0 THEN '{0}' END, CASE WHEN resolution_risk >= 0.6 THEN '{1}' END,
    CASE WHEN blur_risk >= 0.6 THEN '{2}' END, CASE WHEN compression_risk >= 0.6 THEN '{3}' END,
    CASE WHEN num_faces >= 2 THEN '{4}' END) AS notes FROM comp""".format(*I.NOTES))
def image_notes(spark, sf_dir):
    r = _risk(spark, sf_dir)
    return r.select("image_id", F.array_join("notes", " | ").alias("notes"))


@_img("privacy_gate")("""SELECT image_id, risk_level IN ('medium', 'high') AND num_faces > 0 AS privacy_applied
FROM lvl""")
def privacy_gate(spark, sf_dir):
    return I.privacy_gate(_risk(spark, sf_dir))


@_img("redaction_boxes")("""SELECT * FROM (SELECT b.image_id, b.det_id,
    GREATEST(0, LEAST(b.w - 1, b.x1)) AS x1, GREATEST(0, LEAST(b.h - 1, b.y1)) AS y1,
    GREATEST(0, LEAST(b.w, b.x2)) AS x2, GREATEST(0, LEAST(b.h, b.y2)) AS y2, 35 AS kernel
  FROM boxes b WHERE b.image_id IN (SELECT image_id FROM lvl WHERE risk_level IN ('medium', 'high') AND num_faces > 0)) r
WHERE x2 > x1 AND y2 > y1""")
def redaction_boxes(spark, sf_dir):
    return I.redaction_boxes(_risk(spark, sf_dir), _boxes(spark, sf_dir))


@query("accounts_with_image_risk", with_fixtures(["accounts"] + IMG_FX, IMAGE_CTES + """
SELECT a.id, ROUND(l.score, 6) AS image_risk_score, l.risk_level AS image_risk_level
FROM accounts a LEFT JOIN lvl l ON l.image_id = a.id"""))
def accounts_with_image_risk(spark, sf_dir):
    r = _risk(spark, sf_dir).select("image_id", r6("score").alias("image_risk_score"),
                                    F.col("risk_level").alias("image_risk_level"))
    a = td.accounts(spark, sf_dir)
    return (a.join(r, F.col("id") == F.col("image_id"), "left")
            .select("id", "image_risk_score", "image_risk_level"))


@_img("face_box_lists")("""SELECT image_id, string_agg(concat_ws(':', det_id, x1, y1, x2, y2), ' '
    ORDER BY score DESC, det_id) AS boxes FROM boxes GROUP BY image_id""")
def face_box_lists(spark, sf_dir):
    """Strongest box first; each box shown as id and corners."""
    shown = F.transform("boxes", lambda b: F.concat_ws(":", *[
        b[c].cast("string") for c in ("det_id", "x1", "y1", "x2", "y2")]))
    return I.box_lists(_boxes(spark, sf_dir)).select("image_id", F.array_join(shown, " ").alias("boxes"))


_SIGNALS = {"face_area_ratio": 4, "laplacian_variance": 2, "blur_risk": 3, "compression_proxy": 3,
            "compression_risk": 3, "edge_density": 4, "edge_risk": 3, "color_variance_norm": 3,
            "color_risk": 3, "resolution_risk": 3, "multi_face_risk": 3, "no_face_risk": 3}


@_img("image_signal_struct")("SELECT image_id, ROUND(score, 3) AS profile_image_risk_score, risk_level, "
                             "num_faces > 0 AS face_detected, num_faces, width, height, min_side, "
                             + ", ".join(f"ROUND({c}, {n}) AS {c}" for c, n in _SIGNALS.items()) + " FROM lvl")
def image_signal_struct(spark, sf_dir):
    """The nested report record, flattened for the comparison."""
    r = I.signal_struct(_risk(spark, sf_dir))
    return r.select("image_id", "profile_image_risk_score", "risk_level", "signals.face_detected",
                    "signals.num_faces", "signals.resolution.*", *[f"signals.{c}" for c in _SIGNALS])
