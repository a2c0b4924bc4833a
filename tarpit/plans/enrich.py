"""L1: sessions -> the 49-column enriched session table.

flags (P10-P12) -> batch ids / session ids (S4, P20) -> z-scores (A3) ->
IP scope (P6) -> clustering, labels, weights, anomalies, stability (M16,
A5, A6, M6, M7) -> composite risk (P13) -> geo range join (J4, P8, P9) ->
threat level (P15) -> campaigns (A7, J2) -> threat map (P16, P17) ->
supervised risk model (M17) -> PCA (M15) -> conform (S14).

``scope_cols=["batch_id"]`` reproduces the reference's per-upload-batch
statistics (z-scores, auth-feature scaling, cluster labels and weights,
campaigns); the default computes them over the whole input. Model fits
(k-means, forests, PCA) are whole-input, unless ``clusterer=models_per_batch``
gives every upload batch a k-means and an isolation forest of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..operators import clustering as C
from ..operators import geo as G
from ..operators.common import materialize
from ..operators.features import AUTH_FEATURES, CLUSTER_FEATURES, behavior_flags, standardize, zscore
from ..operators.grouped_kmeans import cluster_by_group
from ..operators.ids import BATCH_SIZE, SESSION_COUNTER_START, with_batch_ids
from ..operators.isolation_forest import isolation_forest
from ..operators.ml import ml_risk, pca2
from ..operators.sessionize import emission_order
from ..schemas import ENRICHED, conform

EXTRA_COLS = ("seg", "batch_id")


def models_per_batch(df: DataFrame, scope_cols=("batch_id",), seed: int = 42) -> DataFrame:
    """M16 + M6 with models of their own for every batch (``clusterer`` of ``enrich``, with the
    same ``scope_cols``): clusters, their stability and anomalies, all batches in the same jobs."""
    scope = list(scope_cols)
    scaled = standardize(materialize(df, "features"), CLUSTER_FEATURES, scope_cols=scope, suffix="_kz")
    zcols = [f"{c}_kz" for c in CLUSTER_FEATURES]
    clustered = materialize(cluster_by_group(scaled, scope, zcols, most=C.FINAL_K_CAP).drop(*zcols), "clusters")
    auth = [f"{c}_if" for c in AUTH_FEATURES]
    forest = isolation_forest(standardize(clustered, AUTH_FEATURES, scope_cols=scope, suffix="_if"), auth, seed=seed, group_cols=scope)
    return forest.drop(*auth, "anomaly_score")


def enrich(sessions: DataFrame, ranges: DataFrame, clusterer: Callable[[DataFrame], DataFrame] | None = None,
           with_ml: bool = True, with_pca: bool = True, scope_cols=None, seed: int = 42,
           batch_size: int = BATCH_SIZE, id_start: int = SESSION_COUNTER_START,
           info: dict | None = None, materialize_output: bool = True,
           history: DataFrame | None = None) -> DataFrame:
    """Run the whole enrichment; ``clusterer`` replaces k-means + isolation
    forest with a given assignment (used for SQL-checkable runs).

    ``sessions`` must carry first_seq/last_seq/closed (``sessionize(...,
    keep_order_cols=True)``) for the arrival-ordered ids. The result is
    checkpointed (``materialize_output``) because reports read it many times.
    ``history`` (stored sessions) switches the model metrics to the
    cumulative evaluation (M13) when it applies.
    """
    info = {} if info is None else info
    # Sessions table: written once. The range partitioning behind the ids
    # samples its input in a separate pass, which must not re-run the
    # sessionizer.
    df = materialize(behavior_flags(sessions), "sessions")
    df = with_batch_ids(df, emission_order(), batch_size=batch_size, id_start=id_start)
    df = df.drop("first_seq", "last_seq", "closed")
    df = zscore(df, scope_cols=scope_cols)
    df = G.with_ip_scope(df)

    if clusterer is None:
        # The model fits pass over the feature table many times: write it
        # once. (Without them, everything above is a written table plus
        # scalar statistics and a one-row-per-partition offset broadcast.)
        df = materialize(df, "features")
        clustered, cinfo = C.behavioral_clustering(df, seed=seed)
        info["clustering"] = cinfo
        auth = [c for c in AUTH_FEATURES if c in df.columns]
        if len(auth) < 2:
            auth = [c for c in ("session_duration", "failed_logins") if c in df.columns]
        failed = "error" in cinfo
        if not failed:
            z = standardize(clustered, auth, scope_cols=scope_cols, suffix="_if")
            df = isolation_forest(z, [f"{c}_if" for c in auth], seed=seed).drop(
                *[f"{c}_if" for c in auth], "anomaly_score")
        if failed:
            # The reference's fallback for the whole clustering block: nothing to cluster.
            df = (df.withColumn("behavior_cluster", F.lit(0)).withColumn("behavior_label", F.lit("Unknown"))
                  .withColumn("cluster_weight", F.lit(2.0)).withColumn("cluster_stability", F.lit(0.0))
                  .withColumn("is_anomaly", F.lit(False)).withColumn("dbscan_label", F.lit(0)))
    else:
        df = clusterer(df)
        labels = C.label_clusters(df, scope_cols=scope_cols)
        df = C.apply_cluster_labels(df, labels, scope_cols=scope_cols)

    df = C.risk_score(df).drop("cluster_weight")
    df = G.geo_enrich(df, ranges)
    anomaly = "is_anomaly" if "is_anomaly" in df.columns else None
    df = df.withColumn("risk_level", L.threat_level(behavior_label="behavior_label", is_anomaly=anomaly))
    df = G.campaign_join(df, scope_cols=scope_cols)
    df = C.cluster_threat_map(df)
    if clusterer is None and "error" in info.get("clustering", {}):
        df = (df.withColumn("attacker_type", F.lit("Unclassified")).withColumn("threat_archetype", F.lit("Unknown"))
              .withColumn("confidence_level", F.lit("Low")).withColumn("geo_visualization", F.lit("disabled")))

    if with_ml:
        if clusterer is None:
            df = materialize(df)
        df, metrics = ml_risk(df, seed=seed, history=history)
        info["metrics"] = metrics
    if with_pca:
        df = pca2(df)
    out = conform(df, ENRICHED, keep_extra=EXTRA_COLS)
    return materialize(out) if materialize_output else out
