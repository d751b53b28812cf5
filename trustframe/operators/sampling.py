"""Class-balanced sampling, splits, folds, class weights, imputation, scaling.

Sampling order is a seeded hash of the row id, so samples are reproducible
without a global sort.  Exact per-class caps come from one boundary per class:
a (class x 65,536 hash buckets) count table names the bucket the cap falls in,
and only that bucket (about n_class / 65,536 rows) is ranked to find the
boundary (bucket, hash, id).  The sample and its complement are then plain
filters on one read of the input: no join, no shuffle, no class in one task.
Rows that repeat an id stay on one side of the boundary together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42                     # fixed value: seed of every sampler
BALANCED_CAPS = {1: 30_000, 0: 60_000}   # fixed values: bots, humans (2:1)
SUBSAMPLE_ROWS = 120_000      # fixed value: rows of a stratified subsample, where a caller asks for one
TEST_SHARE = 0.2
N_BUCKETS = 1 << 16


def hash_key(id_col: str = "id", seed: int = SEED) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def _inside(df: DataFrame, caps: dict, label: str, id_col: str, seed: int) -> Column:
    """Condition: the row is among the first ``caps[class]`` of its class by hash."""
    h = hash_key(id_col, seed)
    keyed = df.select(F.col(label).alias("_c"), F.col(id_col).alias("_id"), h.alias("_h"),
                      F.pmod(h, F.lit(N_BUCKETS)).alias("_bk")).filter(F.col("_c").isin(*caps))
    cap = F.coalesce(*[F.when(F.col("_c") == k, F.lit(v)) for k, v in caps.items()])
    w = Window.partitionBy("_c").orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0)
    cum = (keyed.groupBy("_c", "_bk").agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_cum", F.sum("_n").over(w)).withColumn("_cap", cap))
    cuts = (cum.filter(F.col("_cum") >= F.col("_cap")).groupBy("_c")
            .agg(F.min_by(F.struct("_bk", (F.col("_cap") - F.col("_cum") + F.col("_n")).alias("need")),
                          "_bk").alias("c"))
            .select("_c", F.col("c._bk").alias("bk"), F.col("c.need").alias("need")).collect())
    inside = {k: F.lit(True) for k in caps}     # a class within its cap is taken whole
    edge = None
    for r in cuts:                              # one row per class
        here = (F.col("_c") == r["_c"]) & (F.col("_bk") == r["bk"])
        edge = here if edge is None else edge | here
    last = {}
    if edge is not None:
        rank = Window.partitionBy("_c").orderBy("_h", "_id")
        need = F.coalesce(*[F.when(F.col("_c") == r["_c"], F.lit(r["need"])) for r in cuts])
        last = {r["_c"]: r for r in keyed.filter(edge).withColumn("_r", F.row_number().over(rank))
                .filter(F.col("_r") == need).collect()}
    bk = F.pmod(h, F.lit(N_BUCKETS))
    for r in cuts:
        at = last.get(r["_c"])                  # none where the cap is 0
        tail = (F.lit(False) if at is None else
                (h < at["_h"]) | ((h == at["_h"]) & (F.col(id_col) <= at["_id"])))
        inside[r["_c"]] = (bk < r["bk"]) | ((bk == r["bk"]) & tail)
    cond = F.lit(False)
    for k, c in inside.items():
        cond = F.when(F.col(label) == k, c).otherwise(cond)
    return cond


def capped_sample(df: DataFrame, caps: dict, label: str = "label", id_col: str = "id",
                  seed: int = SEED) -> DataFrame:
    """``min(cap, class size)`` rows per class, chosen by seeded hash order.

    Classes missing from ``caps`` are dropped (as the reference keeps only the
    two sampled classes).
    """
    return df.filter(_inside(df, caps, label, id_col, seed))


def balanced_sample(df: DataFrame, label: str = "label", seed: int = SEED,
                    caps: dict = BALANCED_CAPS) -> DataFrame:
    return capped_sample(df, caps, label, seed=seed)


def equal_sample(df: DataFrame, label: str = "label", cap: int | None = None,
                 seed: int = SEED) -> DataFrame:
    """As many rows of each class as there are bots; ``cap`` may bound them."""
    n = df.filter(F.col(label) == 1).count()
    n = n if cap is None else min(cap, n)
    return capped_sample(df, {1: n, 0: n}, label, seed=seed)


def hash_split(df: DataFrame, test_share: float = TEST_SHARE, id_col: str = "id",
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Deterministic train/test split by hash bucket; class-proportional in expectation."""
    b = F.pmod(hash_key(id_col, seed + 1), F.lit(1_000_000))
    cut = int(round(test_share * 1_000_000))
    return df.filter(b >= cut), df.filter(b < cut)


def stratified_split(df: DataFrame, label: str = "label", test_share: float = TEST_SHARE,
                     id_col: str = "id", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Exact per-class test counts round(share * n_c); the rest is the train part.

    Rows without a label train.  Falls back to the hash split when a class has
    fewer than 2 rows.
    """
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return hash_split(df, test_share, id_col, seed)
    caps = {k: int(round(test_share * v)) for k, v in counts.items()}
    test = _inside(df, caps, label, id_col, seed + 1)
    return df.filter(~test), df.filter(test)


def stratified_subsample(df: DataFrame, rows: int = SUBSAMPLE_ROWS, label: str = "label",
                         seed: int = SEED) -> DataFrame:
    """At most ``rows`` rows keeping the class ratio (no-op when smaller)."""
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= rows:
        return df
    caps = {k: int(round(rows * v / total)) for k, v in counts.items()}
    return capped_sample(df, caps, label, seed=seed)


def hash_ranks(df: DataFrame, h: Column, groups: tuple[str, ...] = (), tie: str = "id",
               name: str = "rank") -> DataFrame:
    """0-based rank of each row by ``h`` within ``groups``, without one task per group.

    Two levels: the rows of the hash buckets before the row's own (a table of
    at most 65,536 rows per group) plus its rank inside the bucket.
    """
    keyed = df.withColumns({"_h": h, "_bk": F.pmod(h, F.lit(N_BUCKETS))})
    own = [F.col(g).alias(f"_g_{g}") for g in groups]
    before = Window.partitionBy(*groups).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy(*groups, "_bk").agg(F.count(F.lit(1)).alias("_n"))
            .select(*own, F.col("_bk").alias("_bb"),
                    F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    rank = Window.partitionBy(*groups, "_bk").orderBy("_h", tie)
    on = F.col("_bk") == F.col("_bb")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = keyed.withColumn("_r", F.row_number().over(rank) - 1).join(base, on)
    return out.select(*df.columns, (F.col("_base") + F.col("_r")).alias(name))


def fold_column(df: DataFrame, k: int, id_col: str = "id", seed: int = SEED,
                name: str = "fold", label: str | None = "label") -> DataFrame:
    """Fold number 0..k-1: a row's rank in its class by seeded hash, modulo k.

    Within each class the folds differ by one row at most.  ``label`` None
    gives plain folds.
    """
    ranked = hash_ranks(df.drop(name), hash_key(id_col, seed + 2), (label,) if label else (), id_col, "_rank")
    return ranked.withColumn(name, F.pmod("_rank", F.lit(k)).cast("int")).drop("_rank")


def n_folds(min_class: int, n: int) -> int:
    """Folds of the wide search: stratified up to 5 and the smallest class; plain up to 5.

    Plain folds (a class of fewer than 2 rows) depend on the row count only.
    """
    return max(2, min(5, min_class, n)) if min_class >= 2 else max(2, min(5, n))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 0).alias("n_human"),
                  F.count_if(F.col(label) == 1).alias("n_bot")).withColumn(
        "imbalance_ratio", F.col("n_human") / F.col("n_bot"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``balanced`` weights n / (k * n_c) per class."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # over the k class rows only
    return per.withColumn("weight", F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))


def with_weight_column(df: DataFrame, weights: DataFrame, label: str = "label",
                       name: str = "weight") -> DataFrame:
    """Attach per-class weights (a k-row table, broadcast by size)."""
    return df.join(F.broadcast(weights.select(label, F.col("weight").alias(name))), label, "left")


def fit_standard_scaler(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """Mean and population sd per column (one aggregate; 2 numbers per column)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def standard_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / sd with sd = 0 treated as 1 (as scikit-learn does)."""
    return df.withColumns({
        c: (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0) for c, (m, s) in params.items()})


def fit_median(df: DataFrame, cols) -> dict[str, float]:
    """Exact median per column (mean of the two middle values), nulls and NaN left out."""
    from .profilestats import exact_quantiles, long_form
    q = exact_quantiles(long_form(df, cols), (0.5,))
    return {r["feature"]: r["quantile"] for r in q.collect()}    # one row per column


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Null and NaN values replaced by the column's exact median; all-null columns stay."""
    medians = fit_median(df, cols)

    def filled(c):
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        return F.coalesce(x, F.lit(medians[c])) if c in medians else x
    return df.withColumns({c: filled(c) for c in cols})
