"""Model training, tuning, calibration and evaluation with MLlib pipelines.

The 25 features stay plain DOUBLE columns until the estimator boundary,
where one ``VectorAssembler`` builds the vector.  Class weights enter as a
``weightCol``; folds come from a seeded hash column, so cross-validation
needs no shuffle of its own.  Evaluation reuses the histogram metrics of
``operators/metrics.py`` on a ``(label, score)`` projection.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest as FO
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import scoring as SC
from ..operators.features import align_to_schema, build_features
from ..operators.isotonic import pooled
from ..operators.labels import drop_target
from ..operators.validation import validate_accounts
from ..schemas import FEATURES
from ..session import materialize
from ..sources import commits

SEED = 42
# rows per partition of a training table: small tables train in one task without a shuffle per level,
# others in a task per core, and no task holds more than the second number
FIT_ROWS_PER_PARTITION = 2_000
MOST_ROWS_PER_PARTITION = 200_000
# ---- fixed values: estimator settings of the reference trainers -------------
BASELINE_NUM = ("followers_count", "following_count", "tweet_count", "listed_count",
                "account_age_days", "followers_following_ratio", "tweets_per_day")
BASELINE_BIN = ("has_profile_image", "has_description", "verified", "has_location", "has_url")
BASELINE_TREES = 300
TUNED_TREES = 200
TUNED_GRID = {"maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2],
              "featureSubsetStrategy": ["sqrt", "0.5"]}      # depth None -> MLlib maximum 30
TUNED_ITER = 8
TUNED_FOLDS = 3
WIDE_RANGES = {"numTrees": (200, 600), "maxDepth": (4, 20), "minInstancesPerNode": (1, 10),
               "featureSubsetStrategy": (0.3, 1.0)}      # upper ends excluded
WIDE_ITER = 25
SEARCH_WAVE = 5            # candidates of one job; results are kept after each
GBT_PARAMS = {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
              "featureSubsetStrategy": "0.8"}
CAL_FOLDS = 3
MAX_DEPTH = 30             # MLlib's deepest tree, for the reference's unlimited depth
DEFAULT_CUT = 0.5          # cut-off of the trainers that learn none
# ---------------------------------------------------------------------------


def training_frame(accounts: DataFrame) -> DataFrame:
    """id, label and the 25 features in training order (absent -> 0)."""
    f = build_features(accounts, keep=("id", "label"))
    return align_to_schema(f, list(FEATURES), keep=("id", "label")).withColumn(
        "label", F.col("label").cast("double"))


def assembler(cols=FEATURES, out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep")


def weighted(df: DataFrame) -> DataFrame:
    return S.with_weight_column(df, S.class_weights(df))


def packed(df: DataFrame) -> DataFrame:
    """The table in as few partitions as its rows need; tree levels run one job each.

    The rows move, so what comes before keeps its own parallelism.
    """
    return df.repartition(fit_partitions(df.count(), df.sparkSession.sparkContext.defaultParallelism))


def fit_partitions(rows: int, cores: int) -> int:
    """Every level of every boosting round is a job, so more tasks than cores only add waves to each."""
    return max(1, min(-(-rows // FIT_ROWS_PER_PARTITION), cores), -(-rows // MOST_ROWS_PER_PARTITION))


def p_bot(_frame: DataFrame | None = None, prob_col: str = "probability") -> F.Column:
    """Bot-class probability out of MLlib's probability vector."""
    return vector_to_array(F.col(prob_col))[1]


def evaluate(pred: DataFrame, score: str = "score", cut: float | None = None) -> dict:
    """Cut-off, AUC, AP, Brier, confusion matrix and report at the cut-off.

    ``cut`` None takes the max-F1 threshold of ``pred``; the baseline and the
    wide trainer pass ``DEFAULT_CUT``.
    """
    ls = pred.select("label", F.col(score).alias("score")).cache()
    try:
        curve = M.pr_curve(ls).cache()
        best = M.best_threshold(curve).first()
        th = best["threshold"] if best and best["threshold"] is not None else DEFAULT_CUT
        th = th if cut is None else cut
        auc = M.roc_auc(curve).first()["roc_auc"]
        ap = M.average_precision(curve).first()["average_precision"]
        brier = M.brier(ls).first()["brier"]
        cm = M.confusion(ls, th)
        rep = {r["class"]: r.asDict() for r in M.classification_report(cm).collect()}
        cm_row = cm.first().asDict()
        curve.unpersist()
    finally:
        ls.unpersist()
    return {"threshold": th, "roc_auc": auc, "average_precision": ap, "brier": brier,
            "confusion": cm_row, "report": rep}


def metrics_table(spark, name: str, ev: dict) -> DataFrame:
    bot = ev["report"].get("Bot", {})
    return spark.createDataFrame([(name, float(ev["threshold"]), ev["roc_auc"], ev["average_precision"],
                                   ev["brier"], bot.get("precision"), bot.get("recall"), bot.get("f1_score"),
                                   ev["report"].get("accuracy", {}).get("f1_score"))],
                                 "model string, threshold double, roc_auc double, average_precision double, "
                                 "brier double, bot_precision double, bot_recall double, bot_f1 double, "
                                 "accuracy double")


# ---- forests grown as tasks (operators/forest.py) in the place of MLlib's models ----

def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores: deep forests make a small table long work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _share(strategy: str, width: int) -> float:
    """MLlib's feature strategy as a share of ``width`` features (sqrt is rounded up)."""
    return (math.ceil(math.sqrt(width)) + 0.5) / width if strategy == "sqrt" else float(strategy)


def _job(trees: int, width: int, maxDepth: int = MAX_DEPTH, minInstancesPerNode: int = 1,
         featureSubsetStrategy: str = "sqrt", **more) -> dict:
    """A forest's settings by MLlib's names as a job of ``forest.fit``."""
    return {"trees": trees, "depth": maxDepth, "least": minInstancesPerNode, "seed": SEED,
            "share": _share(featureSubsetStrategy, width), **more}


class GrownForest:
    """A grown forest used, saved and loaded like a fitted pipeline."""

    def __init__(self, forest: FO.Forest):
        self.forest = forest

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``probability``, the vector of both classes."""
        s = F.col("_forest")
        return (self.forest.transform(df, "_forest")
                .withColumn("probability", array_to_vector(F.array(1.0 - s, s))).drop("_forest"))

    def write(self) -> GrownForest:
        return self

    def save(self, path: str) -> None:
        """Edges and the node arrays of each block of trees, as Parquet."""
        f, spark = self.forest, SparkSession.getActiveSession()
        arrays = ", ".join(f"`{k}` binary" for k in FO.NODE_ARRAYS)
        if f.far:
            blocks = f.far[0].filter(F.col("job") == f.far[1]).withColumn("block", F.monotonically_increasing_id())
        else:
            rows = [{"block": i} | FO.row_of(b) for i, b in enumerate(f.blocks)]
            blocks = spark.createDataFrame(rows, f"block long, depth int, {arrays}")
        bins = spark.createDataFrame([(list(f.features), [e.tolist() for e in f.edges])],
                                     "features array<string>, edges array<array<double>>")
        (blocks.crossJoin(F.broadcast(bins)).select("block", "features", "edges", "depth", *FO.NODE_ARRAYS)
         .write.parquet(path))

    @staticmethod
    def load(path: str) -> GrownForest:
        """The forest, its trees left in the folder where the driver should not hold them."""
        kept = SparkSession.getActiveSession().read.parquet(path)
        bins = kept.select("features", "edges").first()
        size = F.sum(sum(F.length(k) for k in FO.NODE_ARRAYS)).alias("bytes")
        n = kept.agg(size, F.sum(F.length("roots") / np.dtype(np.int64).itemsize).alias("trees")).first()
        forest = FO.Forest(list(bins["features"]), [np.array(e) for e in bins["edges"]], trees=int(n["trees"]))
        if n["bytes"] > FO.HELD_BYTES:
            forest.far = (kept.withColumn("job", F.lit(0)), 0)
        else:
            forest.blocks = [FO.trees_of(r) for r in kept.orderBy("block").collect()]
        return GrownForest(forest)


# ---- T1: baseline forest (scale numerics, pass flags through) -------------------

def baseline_pipeline(trees: int = BASELINE_TREES) -> Pipeline:
    num = VectorAssembler(inputCols=list(BASELINE_NUM), outputCol="num_vec", handleInvalid="keep")
    scale = StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True, withStd=True)
    full = VectorAssembler(inputCols=["num_scaled", *BASELINE_BIN], outputCol="features")
    rf = RandomForestClassifier(numTrees=trees, seed=SEED, weightCol="weight",
                                maxDepth=MAX_DEPTH)
    return Pipeline(stages=[num, scale, full, rf])


def forest_baseline(train: DataFrame, test: DataFrame, trees: int = BASELINE_TREES):
    if train.count() > FO.FIT_ROWS:
        model = baseline_pipeline(trees).fit(packed(weighted(train)))
        return model, model.transform(test).withColumn("score", p_bot(test))
    scale = S.fit_standard_scaler(train, BASELINE_NUM)
    cols = [*BASELINE_NUM, *BASELINE_BIN]
    sample = FO.sample_of(S.standard_scale(train, scale), cols)
    model = GrownForest(FO.fit(train.sparkSession, sample, [_job(trees, len(cols))])[0])
    pred = model.transform(S.standard_scale(spread(test), scale))
    return model, pred.withColumn("score", p_bot(test))


# ---- T2 / T3: tuned forests with cross-validation ---------------------------------

def _forest_pipeline(trees: int, scaled: bool = False, **params) -> tuple[Pipeline, RandomForestClassifier]:
    """Forest over the 25 features; ``scaled`` puts median imputation and scaling before it."""
    rf = RandomForestClassifier(numTrees=trees, seed=SEED, weightCol="weight",
                                **{"maxDepth": MAX_DEPTH, **params})
    if not scaled:
        return Pipeline(stages=[assembler(), rf]), rf
    filled = [f"{c}_filled" for c in FEATURES]
    imputer = Imputer(strategy="median", inputCols=list(FEATURES), outputCols=filled, relativeError=1e-6)
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[imputer, assembler(filled, "raw_features"), scale, rf]), rf


def _f1_bot() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)


@dataclass
class Tuned:
    """The forest of the best candidate (none if not asked for), all candidates and their mean F1."""
    bestModel: GrownForest | PipelineModel | None
    candidates: list[dict]
    avgMetrics: list[float]


@dataclass
class Folds:
    """A training table with a fold number in column ``fold``, and the sample of its features on the driver."""
    rows: DataFrame
    sample: FO.Sample


def folded(train: DataFrame, folds: int) -> Folds:
    """Stratified folds of at most ``forest.FIT_ROWS`` rows, for a search and a calibration alike."""
    rows = materialize(S.fold_column(train, folds))
    return Folds(rows, FO.sample_of(rows, list(FEATURES), fold="fold"))


def tuned_forest(train: DataFrame, n_iter: int = TUNED_ITER, folds: int = TUNED_FOLDS,
                 trees: int = TUNED_TREES, parallelism: int = 8, refit: bool = True,
                 ready: Folds | None = None) -> Tuned:
    """Random ``n_iter`` candidates of the grid, F1 of the bot class, k stratified folds.

    All candidates and folds are grown in one job; beyond ``forest.FIT_ROWS``
    rows MLlib searches.  Without ``refit`` the best one is not grown on all rows.
    ``ready`` is ``folded(train, folds)`` where the caller has it.
    """
    grid = [dict(zip(TUNED_GRID, v)) for v in itertools.product(*TUNED_GRID.values())]
    cands = random.Random(SEED).sample(grid, min(n_iter, len(grid)))
    if ready is None and train.count() > FO.FIT_ROWS:
        pipe, rf = _forest_pipeline(trees)
        maps = [{rf.getParam(k): v for k, v in c.items()} for c in cands]
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=_f1_bot(), foldCol="fold",
                            numFolds=folds, parallelism=parallelism, seed=SEED).fit(
                                packed(S.fold_column(weighted(train), folds)))
        return Tuned(cv.bestModel, cands, cv.avgMetrics)
    spark = train.sparkSession
    sample = (ready or folded(train, folds)).sample
    jobs = [_job(trees, len(FEATURES), **c) for c in cands]
    mean = [0.0] * len(jobs)
    for r in FO.cross_validated_f1(spark, sample, jobs, folds).orderBy("job", "fold").collect():
        mean[r["job"]] += r["f1"] / folds
    best = max(range(len(jobs)), key=lambda i: mean[i])
    return Tuned(GrownForest(FO.fit(spark, sample, [jobs[best]])[0]) if refit else None, cands, mean)


def best_params(cv: Tuned) -> dict:
    """Names and values of the candidate with the best mean metric."""
    return dict(cv.candidates[max(range(len(cv.avgMetrics)), key=lambda i: cv.avgMetrics[i])])


def wide_draws(n: int) -> list[dict]:
    """``n`` draws of trees, depth, least rows of a child and share of features."""
    rnd = random.Random(SEED)
    return [{"trees": rnd.randrange(*WIDE_RANGES["numTrees"]), "depth": rnd.randrange(*WIDE_RANGES["maxDepth"]),
             "least": rnd.randrange(*WIDE_RANGES["minInstancesPerNode"]),
             "share": round(rnd.uniform(*WIDE_RANGES["featureSubsetStrategy"]), 4), "seed": SEED + i}
            for i in range(n)]


def wide_candidates(n: int, rf: RandomForestClassifier) -> list[dict]:
    """The same draws as parameters of MLlib's forest."""
    return [{rf.numTrees: d["trees"], rf.maxDepth: d["depth"], rf.minInstancesPerNode: d["least"],
             rf.featureSubsetStrategy: f"{d['share']:.4f}"} for d in wide_draws(n)]


@dataclass
class Search:
    """Best forest of a search, its settings, and every candidate with its F1 (per fold, or the mean)."""
    model: FO.Forest | PipelineModel
    params: dict | None
    results: list[tuple[dict, list[float]]]

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out if isinstance(self.model, FO.Forest) else out.withColumn("score", p_bot())


def _wide_large(folds: DataFrame, k: int, n_iter: int) -> Search:
    """The search with MLlib's distributed trees, for tables that no worker should hold."""
    pipe, rf = _forest_pipeline(BASELINE_TREES, scaled=True)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=wide_candidates(n_iter, rf), evaluator=_f1_bot(),
                        foldCol="fold", numFolds=k, parallelism=8, seed=SEED).fit(packed(weighted(folds)))
    results = [({p.name: v for p, v in m.items()}, [f]) for m, f in zip(cv.getEstimatorParamMaps(), cv.avgMetrics)]
    best = max(range(len(results)), key=lambda i: results[i][1])
    return Search(cv.bestModel, results[best][0], results)


def _known(spark, folder: str | None) -> dict[str, list[float]]:
    """F1 per fold of the candidates that a search in this folder has finished."""
    out = {}
    for name in commits.names(spark, folder) if folder else []:
        out[name] = json.loads(spark.read.text(f"{folder}/{name}").first()[0])["f1"]
    return out


def wide_forest(train: DataFrame, n_iter: int = WIDE_ITER, results: str | None = None) -> Search:
    """Wide random search by the F1 of the bot class; skipped (plain fit) with < 3 rows or one class.

    The training rows are binned once; every (candidate, fold, block of trees)
    is a row of one job.  Imputing and scaling are left out: the features have
    no gaps, and a tree's cuts do not depend on scale.  With ``results``, a
    folder on shared storage, finished candidates are kept and a search that is
    started again goes on after them.  Beyond ``forest.FIT_ROWS`` rows MLlib
    searches.
    """
    spark = train.sparkSession
    counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if n < 3 or len(counts) < 2:
        plain = {"trees": BASELINE_TREES, "depth": MAX_DEPTH, "least": 1, "share": 0.2, "seed": SEED}
        return Search(FO.fit(spark, FO.sample_of(train, list(FEATURES)), [plain])[0], None, [])
    small = min(counts.values())
    k = S.n_folds(small, n)
    folds = S.fold_column(train, k, label="label" if small >= 2 else None)
    if n > FO.FIT_ROWS:
        return _wide_large(folds, k, n_iter)
    sample = FO.sample_of(folds, list(FEATURES), fold="fold")
    cands = wide_draws(min(n_iter, n))
    state = hashlib.sha256(sample.x.tobytes() + sample.y.tobytes() + sample.fold.tobytes()).hexdigest()
    name = [hashlib.sha256(f"{state}{json.dumps(c, sort_keys=True)}".encode()).hexdigest() for c in cands]
    done = _known(spark, results)
    todo = [i for i in range(len(cands)) if name[i] not in done]
    for at in range(0, len(todo), SEARCH_WAVE):
        wave = todo[at:at + SEARCH_WAVE]
        f1 = {i: [0.0] * k for i in wave}
        for r in FO.cross_validated_f1(spark, sample, [cands[i] for i in wave], k).collect():
            f1[wave[r["job"]]][r["fold"]] = r["f1"]
        for i in wave:
            done[name[i]] = f1[i]
            if results:
                commits.publish(spark, f"{results}/{name[i]}", json.dumps({"params": cands[i], "f1": f1[i]}))
    scored = [(c, done[x]) for c, x in zip(cands, name)]
    best = max(scored, key=lambda r: sum(r[1]))[0]
    return Search(FO.fit(spark, sample, [best])[0], best, scored)


# ---- T5: boosted trees -------------------------------------------------------------

def gbt(train: DataFrame, params: dict | None = None, rows: int | None = None):
    """Boosted trees with the positive class up-weighted by n_human / n_bot.

    Fitted on all rows, or on at most ``rows`` in the class ratio of all if the
    caller bounds them; every column but target and id is an input.
    """
    p = dict(GBT_PARAMS, **(params or {}))
    train = train if rows is None else S.stratified_subsample(train, rows)
    bal = train.agg(F.count_if(F.col("label") == 0).alias("h"), F.count_if(F.col("label") == 1).alias("b")).first()
    spw = round(bal["h"] / bal["b"], 2) if bal["b"] else 1.0
    data = train.withColumn("weight", F.when(F.col("label") == 1, F.lit(spw)).otherwise(F.lit(1.0)))
    g = GBTClassifier(seed=SEED, weightCol="weight", **p)
    return Pipeline(stages=[assembler(drop_target(train).columns), g]).fit(packed(data))


# ---- T6 / T7: calibration as an ensemble of held-out fits ------------------------------

def _platt_rows(df: DataFrame, score: str) -> DataFrame:
    """Platt's smoothed targets as two weighted rows per example."""
    cnt = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    t_pos = (cnt["p"] + 1.0) / (cnt["p"] + 2.0)
    t_neg = 1.0 / (cnt["n"] + 2.0)
    t = F.when(F.col("label") == 1, F.lit(t_pos)).otherwise(F.lit(t_neg))
    rows = F.array(F.struct(F.lit(1.0).alias("y"), t.alias("w")),
                   F.struct(F.lit(0.0).alias("y"), (F.lit(1.0) - t).alias("w")))
    return df.select(F.col(score), F.inline(rows))


def _sigmoid(scores: DataFrame) -> PipelineModel:
    """Platt's sigmoid over column ``s``."""
    va = VectorAssembler(inputCols=["s"], outputCol="sv")
    lr = LogisticRegression(featuresCol="sv", labelCol="y", weightCol="w", regParam=0.0,
                            standardization=False, tol=1e-10, maxIter=200)
    return Pipeline(stages=[va, lr]).fit(_platt_rows(scores, "s"))


def calibrated_forest(train: DataFrame, method: str = "sigmoid", folds: int = CAL_FOLDS,
                      params: dict | None = None, trees: int = TUNED_TREES, ready: Folds | None = None):
    """k (base, calibrator) pairs; predictions average the calibrated probabilities.

    ``params`` are forest settings by MLlib's names, ``ready`` is
    ``folded(train, folds)`` where the caller has it.  All bases are grown in
    one job, the calibrators fitted side by side: their jobs are many and
    small.  Beyond ``forest.FIT_ROWS`` rows MLlib fits the bases.
    """
    spark, params = train.sparkSession, params or {}
    if ready is None and train.count() > FO.FIT_ROWS:
        data = materialize(S.fold_column(train, folds))
        pipe, rows = _forest_pipeline(trees, **params)[0], packed(weighted(data)).cache()
        bases = [pipe.fit(rows.filter(F.col("fold") != i)) for i in range(folds)]
        rows.unpersist()
    else:
        ready = ready or folded(train, folds)
        data = ready.rows
        bases = [GrownForest(f) for f in FO.fit(spark, ready.sample, [
            _job(trees, len(FEATURES), **params, leave_out=i) | {"seed": SEED + i} for i in range(folds)])]

    def calibrator(i: int):
        held = spread(data.filter(F.col("fold") == i))
        s = materialize(bases[i].transform(held).select("label", p_bot().alias("s")))
        if method == "isotonic":
            # the levels are found on the executors; the estimator's last step, which runs on
            # the driver, gets two rows per level
            return IsotonicRegression(featuresCol="s", labelCol="label", weightCol="w",
                                      predictionCol="cal").fit(pooled(s))
        return _sigmoid(s)

    with ThreadPoolExecutor(folds) as pool:
        found = [pool.submit(inheritable_thread_target(spark)(calibrator), i) for i in range(folds)]
        return list(zip(bases, [f.result() for f in found]))


def predict_calibrated(members, df: DataFrame, method: str = "sigmoid") -> DataFrame:
    """Average of the members' calibrated bot probabilities in column ``score``."""
    bases = [base for base, _ in members]
    grown = all(isinstance(b, GrownForest) for b in bases)
    out = FO.scored_by(df, {f"_s{i}": b.forest for i, b in enumerate(bases)}) if grown else df
    parts = []
    for i, (base, cal) in enumerate(members):
        s = f"_s{i}"
        if not grown:
            out = (base.transform(out).withColumn(s, p_bot())
                   .drop("features", "rawPrediction", "probability", "prediction"))
        if method == "isotonic":
            out = cal.transform(out.withColumn("s", F.col(s))).withColumnRenamed("cal", f"_c{i}").drop("s")
        else:
            out = (cal.transform(out.withColumn("s", F.col(s)))
                   .withColumn(f"_c{i}", p_bot(out))
                   .drop("sv", "rawPrediction", "probability", "prediction", "s"))
        parts.append(F.col(f"_c{i}"))
    avg = sum(parts[1:], parts[0]) / len(parts)
    return out.withColumn("score", avg)


def calibrated_blocks(train: DataFrame, folds: int = CAL_FOLDS, trees: int = TUNED_TREES,
                      share: float = 0.2) -> FO.Calibrated:
    """The sigmoid-calibrated forest with its trees grown in blocks; at most ``forest.FIT_ROWS`` rows."""
    spark = train.sparkSession
    sample = FO.sample_of(S.fold_column(train, folds, name="cal_fold"), list(FEATURES), fold="cal_fold")
    jobs = [{"trees": trees, "depth": MAX_DEPTH, "least": 1, "share": share, "seed": SEED + i, "leave_out": i}
            for i in range(folds)]
    members = []
    # importance walks swapped rows in the workers' own copies, so these trees are always held
    for i, forest in enumerate(FO.fit(spark, sample, jobs, held=math.inf)):
        held = sample.fold == i
        s = spark.createDataFrame(list(zip(sample.y[held].tolist(), forest.scores(sample.x[held]).tolist())),
                                  "label int, s double")
        lr = _sigmoid(s).stages[-1]
        members.append((forest, float(lr.coefficients[0]), float(lr.intercept)))
    return FO.Calibrated(members)


def calibration_plan(train: DataFrame) -> tuple[str | None, int]:
    """(method, folds) by the reference's rule: no calibration with < 10 rows or
    one class (or a class under 2 rows); isotonic from 100 rows, else sigmoid;
    folds = max(2, min(3, smallest class, rows))."""
    counts = [r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()]
    n = sum(counts)
    if len(counts) < 2 or min(counts) < 2 or n < 10:
        return None, 0
    return ("isotonic" if n >= 100 else "sigmoid"), max(2, min(3, min(counts), n))


def fit_calibrated(train: DataFrame, trees: int = TUNED_TREES):
    """Calibrated forest following ``calibration_plan``; a plain fit when skipped."""
    method, folds = calibration_plan(train)
    if method is None:
        sample = FO.sample_of(train, list(FEATURES))
        return None, GrownForest(FO.fit(train.sparkSession, sample, [_job(trees, len(FEATURES))])[0])
    return method, calibrated_forest(train, method, folds, trees=trees)


# ---- the production trainer: sample, split, search, calibrate, threshold ------------------

def train_production(accounts: DataFrame, caps: dict = S.BALANCED_CAPS, n_iter: int = TUNED_ITER,
                     folds: int = TUNED_FOLDS, trees: int = TUNED_TREES) -> tuple[list, dict]:
    """(calibrated members, run summary) of the tuned forest on a balanced sample.

    The best candidate of the search is what gets calibrated (sigmoid, 3
    folds), and the max-F1 threshold on the holdout is the one scoring uses.
    ``caps`` bounds the labelled rows that are fitted, per class.
    """
    # counted, sampled and split many times over: derived from the accounts once
    data = materialize(training_frame(accounts).filter(F.col("label").isNotNull()))
    train, test = S.stratified_split(S.balanced_sample(data, caps=caps))
    train, test = train.cache(), test.cache()
    try:
        # search and calibration hold out the same folds where they have as many
        ready = folded(train, folds) if folds == CAL_FOLDS and train.count() <= FO.FIT_ROWS else None
        # only the settings are used: the calibrated members are grown from them
        params = best_params(tuned_forest(train, n_iter, folds, trees, refit=False, ready=ready))
        members = calibrated_forest(train, "sigmoid", params=params, trees=trees, ready=ready)
        ev = evaluate(predict_calibrated(members, spread(test), "sigmoid"))
        n = data.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("label") == 0).alias("human"),
                     F.count_if(F.col("label") == 1).alias("bot")).first()
        summary = {
            "n_samples": n["all"], "n_features": len(FEATURES),
            "class_balance": {"0_human": n["human"], "1_bot": n["bot"]},
            "train_rows": train.count(), "test_rows": test.count(), "best_params": params,
            "optimal_threshold": float(ev["threshold"]),
            "test_metrics": {"report": ev["report"], "confusion_matrix": [
                [ev["confusion"]["tn"], ev["confusion"]["fp"]],
                [ev["confusion"]["fn"], ev["confusion"]["tp"]]], "roc_auc": ev["roc_auc"]}}
    finally:
        train.unpersist()
        test.unpersist()
    return members, summary


def score_accounts(accounts: DataFrame, members: list, threshold: float, image: str = "img") -> DataFrame:
    """Validated accounts scored with calibrated members: one nested result per account."""
    ok = validate_accounts(accounts).filter(F.col("status") == "accepted")
    f = build_features(ok, keep=("id", image, "label"))
    # the heuristic reads base columns, which are features under the same names; the rows are small
    # for their work, so they are dealt to all cores and not packed by their bytes
    feats = spread(align_to_schema(f, list(FEATURES), keep=("id", image)))
    pred = predict_calibrated(members, feats, "sigmoid")
    return scored_result(pred.withColumnRenamed("score", "p"), "p", image, threshold)


def scored_result(df: DataFrame, p: str, image: str, threshold: float) -> DataFrame:
    """id, user (four fields and the combined probability), heuristics, ensemble."""
    heur = SC.heuristic_score()
    shown = F.round(F.col(p), 3)
    user = SC.user_result(p, threshold)
    return df.select(
        "id",
        F.struct(*[user[c].alias(c) for c in ("is_bot", "bot_probability", "risk_level", "threshold_used")],
                 SC.combined_probability(shown, image).alias("combined_bot_probability")).alias("user"),
        F.struct(heur.alias("heuristic_score")).alias("heuristics"),
        SC.ensemble_struct(shown, heur, image).alias("ensemble"))
