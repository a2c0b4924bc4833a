"""Behavioural clustering (M2-M8, M16), cluster profiles, labels, weights and
the composite risk score (A4-A6, J6, P13, P16).

Per-cluster tables have at most k <= 5 rows, so joining them back is a
broadcast with a bound fixed by k, not by the data.
"""

from __future__ import annotations

from functools import reduce

from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import labels as L
from .common import materialize, with_scalars
from .features import CLUSTER_FEATURES, standardize

MAX_K = 5
FINAL_K_CAP = 4
# Starts per k; the fit of the lowest cost is kept.
START_SEEDS = (0, 1, 2)
PARALLEL_FITS = 4
# Risk weight by descending cluster rank (last one repeats).
WEIGHT_LEVELS = (2.0, 1.0, 0.0, -0.5)
RISK_WEIGHTS = (0.4, 0.3, 0.2)  # event_count_norm, unique_commands_norm, session_duration_norm


def cluster_profile(df: DataFrame, cluster: str = "behavior_cluster", cols=CLUSTER_FEATURES) -> DataFrame:
    """A4: mean of the clustering features per cluster, rounded half-even to
    2 decimals the way pandas does (scale by 100, round half-even, unscale)."""
    return (df.where(F.col(cluster).isNotNull()).groupBy(cluster)
            .agg(*[(F.bround(F.avg(F.col(c).cast("double")) * 100, 0) / 100).alias(c) for c in cols]))


def label_clusters(df: DataFrame, cluster: str = "behavior_cluster",
                   score: str = "behavioral_risk_score", scope_cols=None) -> DataFrame:
    """A5 + A6: per cluster (per scope) the mean score, label and weight.

    Labels: lowest mean -> Low Risk, highest -> High Risk, others Medium;
    a single cluster is labelled by its mean (>= 2 High, >= 1 Medium).
    Weights by descending rank: 2.0, 1.0, 0.0, then -0.5. Ties by id.
    """
    scope = list(scope_cols or [])
    m = df.where(F.col(cluster).isNotNull()).groupBy(*scope, cluster).agg(
        F.avg(F.col(score).cast("double")).alias("mean_score"))
    # At most k rows per scope: these windows are bounded by k.
    part = [F.col(c) for c in scope] or [F.lit(1)]
    asc = Window.partitionBy(*part).orderBy(F.col("mean_score").asc(), F.col(cluster).asc())
    desc = Window.partitionBy(*part).orderBy(F.col("mean_score").desc(), F.col(cluster).asc())
    m = (m.withColumn("_ra", F.row_number().over(asc))
         .withColumn("_rd", F.row_number().over(desc))
         .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*part))))
    single = (F.when(F.col("mean_score") >= 2, "High Risk").when(F.col("mean_score") >= 1, "Medium Risk")
              .otherwise("Low Risk"))
    label = (F.when(F.col("_n") == 1, single).when(F.col("_ra") == 1, "Low Risk")
             .when(F.col("_ra") == F.col("_n"), "High Risk").otherwise("Medium Risk"))
    levels = F.array(*[F.lit(x) for x in WEIGHT_LEVELS])
    weight = F.element_at(levels, F.least(F.col("_rd"), F.lit(len(WEIGHT_LEVELS))).cast("int"))
    return m.select(*scope, cluster, "mean_score", label.alias("behavior_label"), weight.alias("cluster_weight"))


def apply_cluster_labels(df: DataFrame, labels: DataFrame, cluster: str = "behavior_cluster",
                         scope_cols=None) -> DataFrame:
    """Join labels/weights onto the sessions. Whole-input labels have at
    most k rows and are broadcast; per-scope labels have k rows per batch."""
    keys = [*(scope_cols or []), cluster]
    lab = labels.select(*keys, "behavior_label", "cluster_weight")
    return df.join(lab if scope_cols else F.broadcast(lab), keys, "left")


def risk_score(df: DataFrame, weight: str = "cluster_weight") -> DataFrame:
    """0.4 zE + 0.3 zC + 0.2 zD + cluster weight (missing weight 0)."""
    a, b, c = RISK_WEIGHTS
    base = (F.col("event_count_norm") * a + F.col("unique_commands_norm") * b
            + F.col("session_duration_norm") * c)
    return df.withColumn("risk_score", base + F.coalesce(F.col(weight), F.lit(0.0)))


def cluster_threat_map(df: DataFrame, cluster: str = "behavior_cluster") -> DataFrame:
    """P16 + P17: attacker type, archetype, confidence, geo flag, SOC tag."""
    out = df.withColumns(L.cluster_threat_cols(cluster))
    scope = "ip_scope" if "ip_scope" in df.columns else None
    geo = L.geo_visualization(scope) if scope else F.lit("disabled")
    return out.withColumn("geo_visualization", geo).withColumn("soc_relevance", F.lit(L.SOC_RELEVANCE))


# --------------------------------------------------------------------------
# Sampling, k-means, silhouette, adjusted Rand.


def sample_n(df: DataFrame, n: int, seed: int, key_cols=("session", "seg")) -> DataFrame:
    """M2: at most n rows without replacement, deterministic under any
    partitioning (order by a seeded hash of the row key that any SQL engine has;
    top-n per task)."""
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def _vectors(df: DataFrame, cols, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def fit_kmeans(df: DataFrame, k: int, seed: int, cols, max_iter: int = 20):
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="_raw_cluster")
    return km.fit(df if "features" in df.columns else _vectors(df, cols))


def silhouette(df: DataFrame, label: str, cols) -> DataFrame:
    """M4: mean silhouette (squared Euclidean) computed from per-cluster sums.

    For a point x and cluster C with n_C points, sum S_C and sum of squared
    norms Q_C, the mean squared distance is (n_C |x|^2 - 2 x.S_C + Q_C) / n_C;
    the own cluster excludes the point itself (factor n_C / (n_C - 1)).
    The <= k cluster sums travel as one scalar (an array of structs) and
    every point is scored against them with array functions: O(rows x k), no pairs, no
    shuffle of the points. Returns one row ``silhouette``.
    """
    xs = [F.col(f"_x{i}") for i in range(len(cols))]
    pts = df.select(F.col(label).alias("_own"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    pts = pts.withColumn("_sq", reduce(lambda a, b: a + b, [x * x for x in xs]))
    stats = pts.groupBy(F.col("_own").alias("c")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_sq").alias("q"),
        *[F.sum(f"_x{i}").alias(f"s{i}") for i in range(len(cols))])
    packed = stats.agg(F.collect_list(F.struct(*stats.columns)).alias("_cl"))
    j = with_scalars(pts, packed)

    def dist(x):
        dot = reduce(lambda a, b: a + b, [F.col(f"_x{i}") * x[f"s{i}"] for i in range(len(cols))])
        return (x["n"] * F.col("_sq") - 2 * dot + x["q"]) / x["n"]

    own = F.filter("_cl", lambda x: x["c"] == F.col("_own"))[0]
    n_own = own["n"]
    a = F.when(n_own > 1, dist(own) * n_own / (n_own - 1)).otherwise(F.lit(0.0))
    b = F.array_min(F.transform(F.filter("_cl", lambda x: x["c"] != F.col("_own")), dist))
    s = (F.when((n_own <= 1) | b.isNull(), F.lit(0.0))
         .otherwise(F.try_divide(b - a, F.greatest(a, b))))  # coinciding clusters: 0
    return j.select(F.coalesce(s, F.lit(0.0)).alias("_s")).agg(F.avg("_s").alias("silhouette"))


#: Rows of the sample that ``silhouette_euclidean`` compares, at most (fixed by the reference).
SILHOUETTE_ROWS = 2_000


def silhouette_euclidean(df: DataFrame, label: str, cols, n: int = SILHOUETTE_ROWS, seed: int = 42,
                         key_cols=("session", "seg")) -> DataFrame:
    """M4 + J8: mean silhouette with Euclidean distances of a sample of at most ``n`` rows
    (M2), every row of the sample against every other. One row ``silhouette``.

    The sample travels as one scalar of ``n`` points; a row's distances are summed by
    cluster before anything is shuffled. Points alone in their cluster, or with one
    cluster in the sample, count 0.
    """
    point = F.array(*[F.col(c).cast("double") for c in cols])
    chosen = sample_n(df, n, seed, key_cols).select(F.col(label).alias("c"), point.alias("x"))
    pts = materialize(chosen.withColumn("id", F.monotonically_increasing_id()), "silhouette")
    rows = with_scalars(pts.repartition("id"), pts.agg(F.collect_list(F.struct("c", "x")).alias("all")))
    pairs = rows.select("id", "c", "x", F.explode("all").alias("o"))
    gaps = F.sqrt(reduce(lambda a, b: a + b, [(F.col("x")[i] - F.col("o.x")[i]) * (F.col("x")[i] - F.col("o.x")[i]) for i in range(len(cols))]))
    per = pairs.groupBy("id", "c", F.col("o.c").alias("other")).agg(F.sum(gaps).alias("d"), F.count(F.lit(1)).alias("m"))
    own = F.col("c").eqNullSafe(F.col("other"))
    ab = per.groupBy("id").agg(F.max(F.when(own & (F.col("m") > 1), F.col("d") / (F.col("m") - 1))).alias("a"),
                               F.min(F.when(~own, F.col("d") / F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return ab.select(F.coalesce(s, F.lit(0.0)).alias("s")).agg(F.avg("s").alias("silhouette"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """M8: adjusted Rand index of two labelings (one row ``ari``).

    Contingency counts by one grouped aggregate; pair sums from them. Full
    agreement of trivial labelings (expected == max) gives 1.0.
    """
    c2 = lambda x: x * (x - 1) / 2.0
    cont = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_nij"))
    rows = cont.groupBy(a).agg(F.sum("_nij").alias("_ai")).agg(F.sum(c2(F.col("_ai"))).alias("_sa"))
    cols = cont.groupBy(b).agg(F.sum("_nij").alias("_bj")).agg(F.sum(c2(F.col("_bj"))).alias("_sb"))
    tot = cont.agg(F.sum(c2(F.col("_nij"))).alias("_idx"), F.sum("_nij").alias("_n"))
    j = with_scalars(with_scalars(tot, rows), cols)
    expected = F.coalesce(F.try_divide(F.col("_sa") * F.col("_sb"), c2(F.col("_n"))), F.lit(0.0))  # one row: no pairs
    mx = (F.col("_sa") + F.col("_sb")) / 2.0
    ari = F.when((mx - expected) == 0, F.lit(1.0)).otherwise((F.col("_idx") - expected) / (mx - expected))
    return j.select(ari.alias("ari"))


def canonical_ids(df: DataFrame, raw: str, out: str = "behavior_cluster",
                  score: str = "behavioral_risk_score", cols=CLUSTER_FEATURES) -> DataFrame:
    """Make k-means ids repeatable: renumber clusters 0..k-1 by ascending
    (mean score, mean features)."""
    prof = df.groupBy(raw).agg(F.avg(F.col(score).cast("double")).alias("_ms"),
                               *[F.avg(F.col(c).cast("double")).alias(f"_mf{i}") for i, c in enumerate(cols)])
    w = Window.orderBy("_ms", *[f"_mf{i}" for i in range(len(cols))], raw)
    ids = prof.select(raw, (F.row_number().over(w) - 1).cast("int").alias(out))
    return df.join(F.broadcast(ids), raw, "left").drop(raw)


def best_kmeans(vectors: DataFrame, k: int, seed: int, starts=START_SEEDS) -> KMeansModel:
    """The k-means fit of lowest cost over all rows of ``vectors`` (column ``features``)."""
    fits = [fit_kmeans(vectors, k, seed + s, None) for s in starts]
    return min(fits, key=lambda m: m.summary.trainingCost)


def enough_to_cluster(df: DataFrame, cols) -> bool:
    """Whether there are two rows at least and a feature that varies."""
    spread = [F.max(c) > F.min(c) for c in cols]
    r = df.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"v{i}") for i, x in enumerate(spread)]).first()
    return r["n"] > 1 and any(r[f"v{i}"] for i in range(len(cols)))


def search_kmeans(df: DataFrame, cols, ks=range(2, MAX_K + 1), seed: int = 42, euclidean: bool = False) -> tuple[int, list[dict], dict[int, KMeansModel]]:
    """M3: (best k, [{k, inertia, silhouette}], the best model of each k), k by the silhouette
    over all rows (default 2), or by ``silhouette_euclidean`` of a sample.

    All-constant features or too few rows give k = 2 without fitting. All fits, each
    start of each k, run side by side as Spark jobs over one cached table, then the
    silhouettes of the winners.
    """
    cols = list(cols)
    n = df.count()
    none = 2, [{"k": 2, "inertia": 0.0, "silhouette": 0.0}], {}
    if not enough_to_cluster(df, cols):
        return none
    vectors = _vectors(df.select(*cols), cols).persist(StorageLevel.MEMORY_AND_DISK)
    models: dict[int, KMeansModel] = {}

    def fit(job: tuple[int, int]) -> tuple[int, KMeansModel]:
        return job[0], fit_kmeans(vectors, job[0], seed + job[1], None)

    def trial(k: int) -> dict | None:
        labelled = models[k].transform(vectors)
        if labelled.select("_raw_cluster").distinct().count() < 2:
            return None
        s = (silhouette_euclidean(labelled, "_raw_cluster", cols, key_cols=cols) if euclidean
             else silhouette(labelled, "_raw_cluster", cols)).first()["silhouette"]
        return {"k": k, "inertia": round(models[k].summary.trainingCost, 4), "silhouette": round(s, 4)}

    try:
        vectors.count()  # cached before the fits, which would each compute it
        with ThreadPool(PARALLEL_FITS) as pool:
            for k, model in pool.map(fit, [(k, s) for k in ks if k <= n for s in START_SEEDS]):
                if k not in models or model.summary.trainingCost < models[k].summary.trainingCost:
                    models[k] = model
            results = [r for r in pool.map(trial, list(models)) if r]
    finally:
        vectors.unpersist()
    if not results:
        return none
    best = max(results, key=lambda r: (r["silhouette"], -r["k"]))
    return best["k"], results, models


def choose_k(df: DataFrame, cols, ks=range(2, MAX_K + 1), seed: int = 42, euclidean: bool = False,
             models: dict[int, KMeansModel] | None = None) -> tuple[int, list[dict]]:
    """M3: the first two of ``search_kmeans``; its models are added to ``models``."""
    k, trials, found = search_kmeans(df, cols, ks, seed, euclidean)
    if models is not None:
        models.update(found)
    return k, trials


def cluster_stability(df: DataFrame, cols, k: int = 3, seeds=(0, 10, 20)) -> float:
    """M7: mean adjusted Rand index between k-means runs with seeds s and
    s + 1 over all rows (the pairs run side by side); 0 if nothing can be clustered."""
    cols = list(cols)
    if not enough_to_cluster(df, cols):
        return 0.0
    vectors = _vectors(df.select(*cols), cols).persist(StorageLevel.MEMORY_AND_DISK)

    def pair(s: int) -> float:
        one, two = (fit_kmeans(vectors, k, x, None) for x in (s, s + 1))
        both = two.transform(one.transform(vectors).withColumnRenamed("_raw_cluster", "_first"))
        return adjusted_rand(both, "_first", "_raw_cluster").first()["ari"]

    try:
        with ThreadPool(len(seeds)) as pool:
            found = pool.map(pair, seeds)
    finally:
        vectors.unpersist()
    return round(sum(found) / len(found), 4)


def cluster_sessions(df: DataFrame, k: int, seed: int = 42, cols=CLUSTER_FEATURES,
                     scaled_suffix: str = "_z", models: dict[int, KMeansModel] | None = None) -> DataFrame:
    """M5: final k-means on the standardised features; canonical ids.

    ``k`` is capped by the row count; fewer than 2 -> everything in cluster 0.
    Expects ``<col><scaled_suffix>`` columns (see ``standardize``). ``models`` by k, of
    ``search_kmeans`` over the same rows, save the fit.
    """
    zcols = [f"{c}{scaled_suffix}" for c in cols]
    vectors = _vectors(df, zcols)
    model = (models or {}).get(k)
    if model is None:
        k = min(k, df.count())
        if k < 2:
            return df.withColumn("behavior_cluster", F.lit(0))
        model = best_kmeans(vectors, k, seed)
    pred = model.transform(vectors).drop("features")
    return canonical_ids(pred, "_raw_cluster")


def cluster_invariants(df: DataFrame, cols, score: str = "behavioral_risk_score") -> DataFrame:
    """One row about sessions with ``behavior_cluster``: how many there are, whether ids count
    from 0 in the order of the mean ``score``, and whether the mean of its own cluster is the
    nearest one for 99 % of the sessions (standardised over all of them)."""
    stats = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    scaled = with_scalars(df, stats).select("behavior_cluster", F.col(score).cast("double").alias("score"), F.array(*[
        F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) for c in cols]).alias("x"))
    centres = scaled.groupBy("behavior_cluster").agg(F.avg("score").alias("risk"), F.array(*[F.avg(F.col("x")[i]) for i in range(len(cols))]).alias("at"))
    packed = centres.agg(F.sort_array(F.collect_list(F.struct("behavior_cluster", "risk", "at"))).alias("centres"))  # k rows
    far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, v: t + v)
    rows = with_scalars(scaled, packed).withColumn("d", F.transform("centres", lambda c: far(F.col("x"), c["at"])))
    near = F.get("d", F.col("behavior_cluster")) <= F.array_min("d") + 1e-9
    ordered = F.forall(F.sequence(F.lit(1), F.size("centres")), lambda i: (F.get(F.col("centres"), i - 1)["behavior_cluster"] == i - 1) & (
        (i == 1) | (F.get(F.col("centres"), i - 1)["risk"] >= F.get(F.col("centres"), F.greatest(i - 2, F.lit(0)))["risk"])))
    return rows.agg(F.count(F.lit(1)).alias("sessions"), F.every(ordered).alias("ids_in_order"),
                    (F.count_if(near) >= 0.99 * F.count(F.lit(1))).alias("nearest_centre"))


def behavioral_clustering(df: DataFrame, seed: int = 42) -> tuple[DataFrame, dict]:
    """Standardise -> choose k -> k-means -> labels -> stability.

    Returns the sessions with behavior_cluster, behavior_label, cluster_weight,
    cluster_stability and run info. If there is nothing to cluster (fewer than
    two rows, or no feature that varies) every row gets the reference's fallback
    values (cluster 0, 'Unknown', stability 0) and the info says why; any failure
    of a job is raised.
    """
    cols = list(CLUSTER_FEATURES)
    zcols = [f"{c}_z" for c in cols]
    if not enough_to_cluster(df, [F.col(c).cast("double") for c in cols]):
        out = (df.withColumn("behavior_cluster", F.lit(0)).withColumn("behavior_label", F.lit("Unknown"))
               .withColumn("cluster_weight", F.lit(2.0)).withColumn("cluster_stability", F.lit(0.0))
               .withColumn("is_anomaly", F.lit(False)).withColumn("dbscan_label", F.lit(0)))
        return out, {"k": 1, "error": "fewer than two rows or no feature that varies", "stability": 0.0}
    scaled = standardize(df, cols)
    models: dict[int, KMeansModel] = {}
    best_k, trials = choose_k(scaled, zcols, seed=seed, models=models)
    final_k = min(best_k, FINAL_K_CAP)
    clustered = cluster_sessions(scaled, final_k, seed, models=models)
    labels = label_clusters(clustered)
    out = apply_cluster_labels(clustered, labels)
    stability = cluster_stability(scaled, zcols)
    out = out.withColumn("cluster_stability", F.lit(stability)).drop(*zcols)
    return out, {"k": final_k, "trials": trials, "stability": stability}
