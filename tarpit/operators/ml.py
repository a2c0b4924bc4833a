"""Supervised risk model, metrics and PCA.

Everything stays distributed: the split ranks rows with a global sequence
(no per-class single-task window), the forest is Spark ML, the PR curve's
cumulative counts are range-partitioned prefix sums, and PCA needs only a
4x4 covariance aggregate (solved on the driver; bounded by the feature count).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import labels as L
from .common import materialize, with_scalars
from .features import CLUSTER_FEATURES, INPUT_FEATURES, apply_scaler, prepare_features, scaler_stats, standardize
from .ids import range_frozen, with_sequence_number

THRESHOLD_CLAMP = (0.20, 0.55)


def stratified_split(df: DataFrame, label: str, test_fraction: float = 0.3, seed: int = 42,
                     key_cols=("session", "seg")) -> DataFrame:
    """M9: add ``is_test``: per class the first ceil(f * n_class) rows in a
    seeded hash order are test rows (plain split if a class is missing)."""
    h = F.xxhash64(*[F.col(c) for c in key_cols], F.lit(seed))
    ranked = with_sequence_number(df.withColumn("_h", h), [F.col(label), F.col("_h"), *key_cols], "_pos")
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    # One row per class value: a tiny table.
    offs = per.select(label, "_nc", F.coalesce(F.sum("_nc").over(w), F.lit(0)).alias("_start"))
    j = ranked.join(F.broadcast(offs), label)
    rank_in_class = F.col("_pos") - F.col("_start")
    return (j.withColumn("is_test", rank_in_class < F.ceil(F.col("_nc") * F.lit(test_fraction)))
            .drop("_h", "_pos", "_nc", "_start"))


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def train_risk_model(train: DataFrame, cols, label: str = "y", seed: int = 42, num_trees: int = 200,
                     max_depth: int = 12, min_leaf: int = 5, positive_weight: float = 3.0):
    """Random forest, class weight 1 : positive_weight."""
    data = assemble(train, cols).withColumn(
        "_w", F.when(F.col(label) == 1, F.lit(positive_weight)).otherwise(F.lit(1.0)))
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=seed,
                                probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred",
                                # More tree nodes per pass over the data -> fewer passes.
                                maxMemoryInMB=1024, cacheNodeIds=True)
    return rf.fit(data.withColumn(label, F.col(label).cast("double")))


def score_risk(model, df: DataFrame, cols, out: str = "ml_risk_score") -> DataFrame:
    """Positive-class probability (0 when the model saw one class),
    clipped to [0, 1], plus the P21 band ``ml_risk_label``."""
    pred = model.transform(assemble(df, cols))
    n_classes = model.numClasses
    p = vector_to_array("_prob")
    prob = p[1] if n_classes >= 2 else F.lit(0.0)
    score = F.least(F.greatest(F.coalesce(prob, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (pred.withColumn(out, score).withColumn("ml_risk_label", L.ml_risk_band(out))
            .drop("features", "_prob", "_raw", "_pred"))


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred", digits: int = 4) -> DataFrame:
    """Accuracy, precision, recall, f1 (zero division -> 0), rounded."""
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    c = df.agg(F.count_if(yy & pp).alias("tp"), F.count_if(~yy & pp).alias("fp"),
               F.count_if(yy & ~pp).alias("fn"), F.count_if(~yy & ~pp).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    zdiv = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = zdiv(tp, tp + fp), zdiv(tp, tp + fn)
    return c.select(
        F.round(zdiv(tp + tn, tp + tn + fp + fn), digits).alias("accuracy"),
        F.round(prec, digits).alias("precision"),
        F.round(rec, digits).alias("recall"),
        F.round(zdiv(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
    )


def prefix_sums(df: DataFrame, order: list, cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Running sums of ``cols`` in ``order`` (inclusive), without a single-task
    window: range-partition (assignment frozen, see ``range_frozen``), sum
    inside each partition (partition-bounded window), add the totals of
    earlier partitions (one row per partition)."""
    ranged = range_frozen(df, order, num_partitions).drop("_mid")
    w_in = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(w_in).alias(f"_cum_{c}") for c in cols])
    tot = ranged.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    w_p = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(w_p), F.lit(0)).alias(f"_o_{c}") for c in cols])
    j = local.join(F.broadcast(offs), "_pid")
    return j.select(*df.columns, *[(F.col(f"_cum_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])


def best_threshold(df: DataFrame, y: str = "y", score: str = "score",
                   clamp=THRESHOLD_CLAMP) -> DataFrame:
    """M12 + W5: F1-maximising threshold over the precision-recall curve.

    For every distinct score t (predict positive when score >= t) the
    cumulative TP/FP come from a prefix sum over descending scores. The best
    F1 wins, the lowest threshold on ties; then clamped. One row:
    best_score, best_f1, threshold.
    """
    pts = df.groupBy(score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    cum = prefix_sums(pts, [F.col(score).desc()], ["pos", "neg"])
    npos = df.agg(F.count_if(F.col(y) == 1).alias("_npos"))
    j = with_scalars(cum, npos)
    f1 = F.when(F.col("cum_pos") + F.col("cum_neg") + F.col("_npos") > 0,
                2.0 * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg") + F.col("_npos"))).otherwise(F.lit(0.0))
    # Highest F1, then the lowest threshold (largest negated score).
    best = j.agg(F.max(F.struct(f1.alias("f1"), (-F.col(score)).alias("neg_t"))).alias("_b"))
    lo, hi = clamp
    t = -F.col("_b.neg_t")
    return best.select(t.alias("best_score"), F.col("_b.f1").alias("best_f1"),
                       F.least(F.greatest(t, F.lit(lo)), F.lit(hi)).alias("threshold"))


def pca2(df: DataFrame, cols=CLUSTER_FEATURES, out=("pca_x", "pca_y"), scope_cols=None) -> DataFrame:
    """Two principal components of the standardised features.

    One aggregate gives the covariance of the (population-)standardised
    columns; the d x d eigenproblem (d = number of features) is solved on the
    driver; the projection is column arithmetic. Sign rule: the largest
    absolute loading of each component is positive. Fewer than 2 columns ->
    zeros.
    """
    cols = [c for c in cols if c in df.columns]
    if len(cols) < 2:
        return df.withColumn(out[0], F.lit(0.0)).withColumn(out[1], F.lit(0.0))
    z = standardize(df, cols, scope_cols=scope_cols, suffix="_pz")
    zc = [f"{c}_pz" for c in cols]
    d = len(cols)
    prods = [F.sum(F.col(zc[i]) * F.col(zc[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    row = z.agg(F.count(F.lit(1)).alias("n"), *prods).first()
    n = row["n"]
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (row[f"c{i}_{j}"] or 0.0) / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1][:2]
    comps = vecs[:, order].T
    for k in range(comps.shape[0]):
        if comps[k, np.argmax(np.abs(comps[k]))] < 0:
            comps[k] = -comps[k]
    proj = [reduce(lambda a, b: a + b, [F.col(zc[i]) * float(comps[k, i]) for i in range(d)]) for k in range(2)]
    return z.withColumn(out[0], proj[0]).withColumn(out[1], proj[1]).drop(*zc)


def _evaluate(model, test: DataFrame, zcols) -> dict:
    """Metrics at 0.5 and at the clamped F1-best threshold."""
    scored_test = materialize(score_risk(model, test, zcols).select("y", "ml_risk_score"),
                              "scored-test").withColumn("pred", (F.col("ml_risk_score") > 0.5).cast("int"))  # a tied vote is the negative class
    at50 = binary_metrics(scored_test, "y", "pred").first().asDict()
    metrics = {"accuracy_at_50": at50["accuracy"], "precision_at_50": at50["precision"],
               "recall_at_50": at50["recall"], "f1_at_50": at50["f1"]}
    thr = 0.5
    if model.numClasses >= 2:
        thr = float(best_threshold(scored_test, "y", "ml_risk_score").first()["threshold"])
    opt = binary_metrics(scored_test.withColumn("pred", (F.col("ml_risk_score") >= thr).cast("int")),
                         "y", "pred").first().asDict()
    cnt = scored_test.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).first()
    metrics.update({**opt, "threshold": round(thr, 4), "test_size": int(cnt["n"]),
                    "anomaly_rate": round(float(cnt["rate"] or 0.0), 4)})
    return metrics


def _split(data: DataFrame, test_fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    classes = data.agg(F.countDistinct("y").alias("k"), F.count(F.lit(1)).alias("n")).first()
    if classes["n"] < 2 or classes["k"] < 2:
        return data, data  # too small or one class: train and test on everything
    split = materialize(stratified_split(data, "y", test_fraction, seed), "split")
    return split.where(~F.col("is_test")), split.where(F.col("is_test"))


def cumulative_evaluation(history: DataFrame, batch_stats: DataFrame, feats: list[str], seed: int = 42,
                          test_fraction: float = 0.3) -> dict | None:
    """Evaluate on the whole stored history.

    Needs >= 10 rows, >= 3 input features and >= 2 auth features. History
    labels are recomputed by the isolation forest on its own standardised
    auth features; the features are scaled with the *batch* scaler; a
    forest is retrained on a stratified 70 % and evaluated on the 30 %.
    Returns None (caller falls back to batch-only) when the conditions or
    both classes are missing.
    """
    from .features import AUTH_FEATURES
    from .isolation_forest import isolation_forest
    avail = [c for c in feats if c in history.columns]
    auth = [c for c in AUTH_FEATURES if c in history.columns]
    if len(avail) < 3 or len(auth) < 2 or history.limit(10).count() < 10:
        return None
    keyed = history if "seg" in history.columns else history.withColumn("seg", F.lit(0).cast("bigint"))
    lab = isolation_forest(standardize(keyed, auth, suffix="_ha"), [f"{c}_ha" for c in auth], seed=seed)
    lab = lab.withColumn("y", F.col("is_anomaly").cast("int"))
    if lab.select("y").distinct().count() < 2:
        return None
    stats = batch_stats.select(*[c for c in batch_stats.columns if c[3:] in avail])
    scaled = apply_scaler(lab, stats, avail, suffix="_ms")
    zcols = [f"{c}_ms" for c in avail]
    train, test = _split(scaled, test_fraction, seed)
    model = train_risk_model(train, zcols, seed=seed)
    return {**_evaluate(model, test, zcols), "eval_mode": "cumulative"}


def _without_model(df: DataFrame, why: str) -> tuple[DataFrame, dict]:
    out = (df.withColumn("ml_risk_score", F.lit(0.0)).withColumn("ml_risk_label", F.lit("Unknown"))
           .withColumn("ml_accuracy", F.lit(0.0)).withColumn("ml_precision", F.lit(0.0))
           .withColumn("ml_recall", F.lit(0.0)))
    return out, {"error": why, "accuracy": 0.0, "precision": 0.0, "recall": 0.0}


def ml_risk(df: DataFrame, seed: int = 42, test_fraction: float = 0.3,
            history: DataFrame | None = None, model_path: str | None = None) -> tuple[DataFrame, dict]:
    """Scale -> stratified split -> forest -> evaluate -> score.

    Label: ``is_anomaly`` if present, else behaviour label == High Risk.
    Adds ml_risk_score, ml_risk_label, ml_accuracy, ml_precision, ml_recall;
    returns the metrics record too. With ``history`` the metrics come from
    the cumulative evaluation (M13) when it applies; scoring always uses the
    batch model. ``model_path`` saves the batch model and its scaler (S12).
    Without rows or without input features the rows get the reference's
    fallback values ('Unknown', zeros); any failure of a job is raised.
    """
    feats = prepare_features(df)
    if not feats:
        return _without_model(df, "no input feature")
    if df.isEmpty():
        return _without_model(df, "no rows")
    stats = scaler_stats(df, feats)
    scaled = apply_scaler(df, stats, feats, suffix="_ms")
    zcols = [f"{c}_ms" for c in feats]
    if "is_anomaly" in df.columns:
        ylab = F.coalesce(F.col("is_anomaly").cast("int"), F.lit(0))
    else:
        ylab = F.coalesce((F.col("behavior_label") == "High Risk").cast("int"), F.lit(0))
    train, test = _split(scaled.withColumn("y", ylab), test_fraction, seed)
    model = train_risk_model(train, zcols, seed=seed)
    if model_path:
        save_risk_model(model, stats, model_path)
    metrics = None
    if history is not None:
        metrics = cumulative_evaluation(history, stats, feats, seed, test_fraction)
    if metrics is None:
        metrics = {**_evaluate(model, test, zcols), "eval_mode": "batch-only"}
    out = score_risk(model, scaled, zcols).drop(*zcols)
    out = (out.withColumn("ml_accuracy", F.lit(metrics["accuracy"]))
           .withColumn("ml_precision", F.lit(metrics["precision"]))
           .withColumn("ml_recall", F.lit(metrics["recall"])))
    return out, metrics


def save_risk_model(model, stats: DataFrame, path: str) -> None:
    """A fitted forest and the scaler statistics it needs (one row)."""
    model.write().overwrite().save(f"{path}/model")
    stats.write.mode("overwrite").parquet(f"{path}/scaler")


def score_with_saved(df: DataFrame, path: str) -> DataFrame:
    """Rows scored by a saved forest, scaled with its own scaler."""
    model = RandomForestClassificationModel.load(f"{path}/model")
    stats = df.sparkSession.read.parquet(f"{path}/scaler")
    feats = prepare_features(df)
    scaled = apply_scaler(df, stats, feats, suffix="_ms")
    zcols = [f"{c}_ms" for c in feats]
    return score_risk(model, scaled, zcols).drop(*zcols)


__all__ = ["stratified_split", "train_risk_model", "score_risk", "binary_metrics", "prefix_sums",
           "best_threshold", "pca2", "ml_risk", "save_risk_model", "score_with_saved", "INPUT_FEATURES"]
