"""Profile-image risk over image-signal and face-detection tables.

The pixel kernels and the face network run upstream; their outputs arrive as
``image_signals`` (one row per image) and ``face_detections`` (one row per
relative box).  Everything here is joins, one grouped aggregate and Column
arithmetic.  Both tables are keyed by ``image_id``: the detection⋈dims join,
the per-image aggregate and the join back to the signals all hash-partition
on that key, so the exchange is shared and skewed images are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01

# ---- fixed values ----------------------------------------------------------
MAX_SIDE = 512
BLUR_REF = 200.0
COMPRESSION_REF = 0.12
EDGE_CENTER, EDGE_SPAN = 0.10, 0.25
COLOR_REF = 5000.0
RES_STEPS = ((96, 1.0), (128, 0.6), (160, 0.3))           # min side < s -> risk
W = {"no_face": 0.30, "resolution": 0.15, "blur": 0.15, "compression": 0.10,
     "edge": 0.10, "color": 0.10, "multi_face": 0.05, "face_area": 0.05}
LEVEL_LOW, LEVEL_MEDIUM = 0.33, 0.66
NOTES = (
    "No face detected (common in logos/default avatars).",
    "Low resolution image; higher uncertainty.",
    "Image appears blurry; face analysis quality reduced.",
    "Image shows signs of heavy compression artifacts.",
    "Multiple faces detected; profile ownership uncertain.",
)
NOTE_CUT = 0.6
DEFAULT_BLUR_STRENGTH = 35
# ---------------------------------------------------------------------------


def resized_dims(signals: DataFrame, max_side: int = MAX_SIDE) -> DataFrame:
    """Width/height after the downscale to ``max_side`` (int truncation)."""
    w, h = F.col("width"), F.col("height")
    m = F.greatest(w, h)
    scale = F.lit(float(max_side)) / m
    return signals.withColumns({
        "width": F.when(m > max_side, (w * scale).cast("bigint")).otherwise(w),
        "height": F.when(m > max_side, (h * scale).cast("bigint")).otherwise(h),
    })


def face_boxes(detections: DataFrame, dims: DataFrame) -> DataFrame:
    """Relative boxes -> pixel boxes clamped to the frame; empty boxes dropped."""
    d = dims.select("image_id", F.col("width").alias("w"), F.col("height").alias("h"))
    j = detections.join(d, "image_id")
    w, h = F.col("w"), F.col("h")
    x1 = F.greatest(F.lit(0.0), F.col("xmin") * w).cast("bigint")
    y1 = F.greatest(F.lit(0.0), F.col("ymin") * h).cast("bigint")
    x2 = F.least(w.cast("double"), (F.col("xmin") + F.col("box_w")) * w).cast("bigint")
    y2 = F.least(h.cast("double"), (F.col("ymin") + F.col("box_h")) * h).cast("bigint")
    return (j.select("image_id", "det_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"),
                     y2.alias("y2"), "score", "w", "h")
            .filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))))


def box_lists(boxes: DataFrame) -> DataFrame:
    """Per image, the boxes strongest first (ties keep detection order)."""
    rec = F.struct(F.col("score"), (-F.col("det_id")).alias("neg_det"), "det_id", "x1", "y1", "x2", "y2")
    return (boxes.groupBy("image_id")
            .agg(F.sort_array(F.collect_list(rec), asc=False).alias("boxes"))
            .select("image_id", F.transform("boxes", lambda b: b.dropFields("neg_det")).alias("boxes")))


def face_stats(boxes: DataFrame) -> DataFrame:
    """num_faces and the area ratio of the highest-score box, per image."""
    area_ratio = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("double") / (
        F.col("w") * F.col("h"))
    return (boxes.groupBy("image_id")
            .agg(F.count(F.lit(1)).alias("num_faces"),
                 F.max_by(area_ratio, F.struct(F.col("score"), -F.col("det_id"))).alias("face_area_ratio")))


def _resolution_risk(min_side: Column) -> Column:
    e = F.lit(0.0)
    for side, risk in reversed(RES_STEPS):
        e = F.when(min_side < side, F.lit(risk)).otherwise(e)
    return e


def component_risks(signals: DataFrame, stats: DataFrame) -> DataFrame:
    """Join signals (resized) with face stats and derive the eight components."""
    dims = resized_dims(signals)
    j = dims.join(stats, "image_id", "left").withColumns({
        "num_faces": F.coalesce("num_faces", F.lit(0)),
        "face_area_ratio": F.coalesce("face_area_ratio", F.lit(0.0)),
    })
    n = F.col("num_faces")
    color_var = F.least(F.lit(1.0), F.col("hsv_variance") / COLOR_REF)
    return j.withColumns({
        "min_side": F.least("width", "height"),
        "face_detected": n > 0,
        "blur_risk": clamp01((F.lit(BLUR_REF) - F.col("laplacian_variance")) / BLUR_REF),
        "compression_risk": clamp01(F.col("compression_proxy") / COMPRESSION_REF),
        "edge_risk": clamp01(F.abs(F.col("edge_density") - EDGE_CENTER) / EDGE_SPAN),
        "color_variance_norm": color_var,
        "color_risk": clamp01(F.lit(1.0) - color_var),
        "resolution_risk": _resolution_risk(F.least("width", "height")),
        "multi_face_risk": F.when(n >= 3, F.lit(0.6)).when(n == 2, F.lit(0.3)).otherwise(F.lit(0.0)),
        "no_face_risk": F.when(n > 0, F.lit(0.0)).otherwise(F.lit(1.0)),
    })


def risk_score(c: DataFrame) -> Column:
    s = (F.lit(W["no_face"]) * F.col("no_face_risk")
         + F.lit(W["resolution"]) * F.col("resolution_risk")
         + F.lit(W["blur"]) * F.col("blur_risk")
         + F.lit(W["compression"]) * F.col("compression_risk")
         + F.lit(W["edge"]) * F.col("edge_risk")
         + F.lit(W["color"]) * F.col("color_risk")
         + F.lit(W["multi_face"]) * F.col("multi_face_risk")
         + F.lit(W["face_area"]) * clamp01(F.col("face_area_ratio") * 3))
    return clamp01(s)


def risk_level(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < LEVEL_LOW, "low").when(s < LEVEL_MEDIUM, "medium").otherwise("high")


def notes(c: DataFrame) -> Column:
    conds = (
        ~F.col("face_detected"),
        F.col("resolution_risk") >= NOTE_CUT,
        F.col("blur_risk") >= NOTE_CUT,
        F.col("compression_risk") >= NOTE_CUT,
        F.col("num_faces") >= 2,
    )
    arr = F.array(*[F.when(cnd, F.lit(t)) for cnd, t in zip(conds, NOTES)])
    return F.filter(arr, lambda x: x.isNotNull())


def image_risk(signals: DataFrame, detections: DataFrame) -> DataFrame:
    """Full per-image result: components, unrounded ``score``, level, notes."""
    boxes = face_boxes(detections, resized_dims(signals))
    comp = component_risks(signals, face_stats(boxes))
    scored = comp.withColumn("score", risk_score(comp))
    return scored.withColumns({"risk_level": risk_level("score"), "notes": notes(scored)})


def signal_struct(r: DataFrame) -> DataFrame:
    """Report form: score rounded to 3 and the explainable signals rounded."""
    return r.select(
        "image_id",
        F.round("score", 3).alias("profile_image_risk_score"),
        "risk_level",
        F.struct(
            F.col("face_detected"), F.col("num_faces"),
            F.round("face_area_ratio", 4).alias("face_area_ratio"),
            F.struct(F.col("width"), F.col("height"), F.col("min_side")).alias("resolution"),
            F.round("laplacian_variance", 2).alias("laplacian_variance"),
            F.round("blur_risk", 3).alias("blur_risk"),
            F.round("compression_proxy", 3).alias("compression_proxy"),
            F.round("compression_risk", 3).alias("compression_risk"),
            F.round("edge_density", 4).alias("edge_density"),
            F.round("edge_risk", 3).alias("edge_risk"),
            F.round("color_variance_norm", 3).alias("color_variance_norm"),
            F.round("color_risk", 3).alias("color_risk"),
            F.round("resolution_risk", 3).alias("resolution_risk"),
            F.round("multi_face_risk", 3).alias("multi_face_risk"),
            F.round("no_face_risk", 3).alias("no_face_risk"),
        ).alias("signals"),
        "notes",
    )


def privacy_gate(r: DataFrame) -> DataFrame:
    """Images whose faces get blurred: level medium/high and at least one box."""
    return r.select("image_id", (F.col("risk_level").isin("medium", "high")
                                 & (F.col("num_faces") > 0)).alias("privacy_applied"))


def redaction_boxes(r: DataFrame, boxes: DataFrame,
                    blur_strength: int = DEFAULT_BLUR_STRENGTH) -> DataFrame:
    """Work list for the blur job: boxes of gated images, clamped to the frame."""
    k = max(3, blur_strength)
    k = k + 1 if k % 2 == 0 else k
    gated = privacy_gate(r).filter("privacy_applied").select("image_id")
    b = boxes.join(gated, "image_id", "left_semi")
    w, h = F.col("w"), F.col("h")
    x1 = F.greatest(F.lit(0), F.least(w - 1, F.col("x1")))
    y1 = F.greatest(F.lit(0), F.least(h - 1, F.col("y1")))
    x2 = F.greatest(F.lit(0), F.least(w, F.col("x2")))
    y2 = F.greatest(F.lit(0), F.least(h, F.col("y2")))
    return (b.select("image_id", "det_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
            .filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
            .withColumn("kernel", F.lit(k)))
