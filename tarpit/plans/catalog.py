"""Query catalog: one callable (spark, sf_dir) -> DataFrame per operator.

Every query starts from the driver tables (the stand-in raw events are the
whole `events` table) and runs the library's own operators on them. Queries
whose name ends in an operator that needs k-means / isolation forest /
random forest have no SQL twin; the others are checked against DuckDB.

Computed doubles are rounded to 6 decimals at the very end so both engines
hash equal values (their float summation orders differ in the last bits).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import ip as I
from ..functions import keys as K
from ..functions import labels as L
from ..operators import clustering as C
from ..operators import features as FE
from ..operators import geo as G
from ..operators import ml as M
from ..operators.common import materialize, with_scalars
from ..operators.ids import with_batch_ids
from ..operators.isolation_forest import isolation_forest
from ..operators.ranges import lookup_by_sweep
from ..operators.sessionize import emission_order, sessionize
from ..session import shared_path
from ..sources import fixtures
from ..sources.events import read_events, stream_events
from ..sources.growing import stream_growing_events
from ..streaming.batches import BatchQueue
from ..streaming.runner import run_incremental, stream_to_table, write_growing_log, write_ndjson
from ..streaming.sessionizer import dedupe_events, stream_sessions
from ..streaming.windows import daily_counts, gap_sessions
from ..sources import sinks as S
from . import dashboard as D
from . import reports as R
from .enrich import enrich, models_per_batch

#: Sessions per upload batch in the queries, so that the test tables fill several.
QUERY_BATCH = 200

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- inputs


def sessions(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Raw events of the test tables, sessionized by the engine."""
    return sessionize(fixtures.raw_events(spark, sf_dir), **kw)


def flagged(spark, sf_dir, **kw) -> DataFrame:
    return FE.behavior_flags(sessions(spark, sf_dir, **kw))


def sessions_table(spark, sf_dir) -> DataFrame:
    """Flagged sessions written once to the shared folder: the model stages
    read them many times (fits, scoring, quantiles, joins)."""
    return materialize(flagged(spark, sf_dir), "sessions")


def rule_enriched(spark, sf_dir, materialize_output: bool = False) -> DataFrame:
    """L1 with stand-in model columns instead of the model stages, batches of 200."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    return enrich(s, fixtures.geo_ranges(spark, sf_dir), clusterer=fixtures.rule_models,
                  with_ml=False, with_pca=False, batch_size=QUERY_BATCH, materialize_output=materialize_output)


def rule_dashboard(spark, sf_dir) -> DataFrame:
    return D.prepare_dashboard(rule_enriched(spark, sf_dir))


def full_enriched(spark, sf_dir, info=None) -> DataFrame:
    """L1 with k-means, isolation forest, random forest and PCA."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    return enrich(s, fixtures.geo_ranges(spark, sf_dir), info=info)


def _text_times(df: DataFrame, cols=("session_start", "session_end")) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, K.fmt_ts(c))
    return df


# ---------------------------------------------------------------- sessions, keys, scalar rules


@query("sessions_batch")
def q_sessions_batch(spark, sf_dir):
    """A1 + W1 + P1/P2/P4/P5: one row per closed-or-open session segment."""
    return _text_times(sessions(spark, sf_dir))


@query("session_hash_keys")
def q_session_hash_keys(spark, sf_dir):
    """P1 + P2: session key (id, else IP, else 'unknown'), its pseudonym, events."""
    raw = fixtures.raw_events(spark, sf_dir)
    g = raw.groupBy(K.session_key().alias("session_key")).agg(F.count(F.lit(1)).alias("events"))
    return g.withColumn("session", K.session_hash("session_key"))


@query("ip_scope_counts")
def q_ip_scope_counts(spark, sf_dir):
    """Sessions and distinct IPs per octet-rule scope."""
    s = G.with_ip_scope(sessions(spark, sf_dir))
    return s.groupBy("ip_scope").agg(F.count(F.lit(1)).alias("sessions"),
                                     F.count_distinct("src_ip").alias("distinct_ips"))


@query("private_ip_split")
def q_private_ip_split(spark, sf_dir):
    """P7 + F4: sessions and distinct IPs by the standards-based private test."""
    s = sessions(spark, sf_dir).withColumn("is_private", I.is_private_ip("src_ip"))
    return s.groupBy("is_private").agg(F.count(F.lit(1)).alias("sessions"),
                                       F.count_distinct("src_ip").alias("distinct_ips"))


@query("behavior_flags")
def q_behavior_flags(spark, sf_dir):
    """Fixed flags and the 0-3 behavioural score per session."""
    return flagged(spark, sf_dir).select("session", "seg", "high_event_activity", "long_session",
                                         "command_heavy", "credential_guessing", "behavioral_risk_score")


@query("median_flags")
def q_median_flags(spark, sf_dir):
    """A2: above-median events / duration (exact, interpolating median)."""
    return FE.median_flags(sessions(spark, sf_dir)).select(
        "session", "seg", "median_high_event_activity", "median_long_session")


@query("zscores")
def q_zscores(spark, sf_dir):
    """A3: z-scores with the sample sd over all sessions."""
    z = FE.zscore(sessions(spark, sf_dir))
    return z.select("session", "seg", *[r6(c).alias(c) for c in
                                        ("event_count_norm", "unique_commands_norm", "session_duration_norm")])


@query("standardize")
def q_standardize(spark, sf_dir):
    """M1: population-sd standardisation of the four clustering features."""
    z = FE.standardize(FE.cluster_features(flagged(spark, sf_dir)), FE.CLUSTER_FEATURES)
    return z.select("session", "seg", *[r6(f"{c}_z").alias(f"{c}_z") for c in FE.CLUSTER_FEATURES])


@query("batch_ids")
def q_batch_ids(spark, sf_dir):
    """S4 + P20 + W3: upload batch and SESS-%05d id in emission order."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    return with_batch_ids(s, emission_order(), batch_size=QUERY_BATCH).select("session", "seg", "batch_id", "session_id")


# ---------------------------------------------------------------- clusters, risk, threat


def _rule_clustered(spark, sf_dir) -> DataFrame:
    return fixtures.rule_clusters(FE.zscore(flagged(spark, sf_dir)))


@query("cluster_labels")
def q_cluster_labels(spark, sf_dir):
    """A5 + A6: label and weight per (rule-assigned) cluster by mean score rank."""
    lab = C.label_clusters(_rule_clustered(spark, sf_dir))
    return lab.select("behavior_cluster", r6("mean_score").alias("mean_score"), "behavior_label", "cluster_weight")


@query("risk_scores")
def q_risk_scores(spark, sf_dir):
    """J6 + P13 + P14: composite risk from z-scores and cluster weights."""
    c = _rule_clustered(spark, sf_dir)
    j = C.risk_score(C.apply_cluster_labels(c, C.label_clusters(c)))
    return j.select("session", "seg", "behavior_cluster", "behavior_label", r6("risk_score").alias("risk_score"),
                    L.zscore_label("risk_score").alias("zscore_label"))


@query("threat_levels")
def q_threat_levels(spark, sf_dir):
    """low/medium/high from thresholds, promoted by High Risk label."""
    c = _rule_clustered(spark, sf_dir)
    j = C.apply_cluster_labels(c, C.label_clusters(c))
    return j.select("session", "seg", "behavior_label",
                    L.threat_level(behavior_label="behavior_label").alias("risk_level"))


@query("cluster_profile")
def q_cluster_profile(spark, sf_dir):
    """A4: per-cluster feature means, rounded half-even to 2 decimals."""
    return C.cluster_profile(fixtures.rule_clusters(flagged(spark, sf_dir)))


@query("threat_map")
def q_threat_map(spark, sf_dir):
    """P16 + P17: attacker type / archetype / confidence and geo flag per session."""
    c = C.cluster_threat_map(G.with_ip_scope(fixtures.rule_clusters(flagged(spark, sf_dir))))
    return c.select("session", "seg", "behavior_cluster", "attacker_type", "threat_archetype",
                    "confidence_level", "geo_visualization", "soc_relevance")


# ---------------------------------------------------------------- geo and campaigns


@query("geo_range_join")
def q_geo_range_join(spark, sf_dir):
    """J4 + P8 + P9: prefix-bucketed range join of public IPs to the range table."""
    s = G.with_ip_scope(sessions(spark, sf_dir))
    g = G.geo_enrich(s, fixtures.geo_ranges(spark, sf_dir))
    return g.select("session", "seg", "src_ip", "ip_scope", *G.GEO_COLS)


@query("geo_nested_ranges")
def q_geo_nested_ranges(spark, sf_dir):
    """J4 over ranges that nest and overlap: the covering range that starts last, by
    disjoint intervals and a sweep."""
    ips = sessions(spark, sf_dir).select("src_ip")
    return lookup_by_sweep(ips, fixtures.nested_ranges(spark, sf_dir), "src_ip")


def _geo_flagged(spark, sf_dir):
    s = G.with_ip_scope(flagged(spark, sf_dir))
    return G.geo_enrich(s, fixtures.geo_ranges(spark, sf_dir))


@query("campaigns")
def q_campaigns(spark, sf_dir):
    """A7 + P18 + P19: campaign aggregate and severity by country + ASN."""
    c = G.campaigns(_geo_flagged(spark, sf_dir))
    return c.select("campaign_key", "campaign_total_sessions", r6("campaign_avg_event_count").alias("campaign_avg_event_count"),
                    r6("campaign_avg_unique_cmds").alias("campaign_avg_unique_cmds"), "campaign_high_activity",
                    "campaign_command_heavy", "campaign_severity")


@query("campaign_join")
def q_campaign_join(spark, sf_dir):
    """Campaign totals and severity attached to every session."""
    j = G.campaign_join(_geo_flagged(spark, sf_dir))
    return j.select("session", "seg", "campaign_key", "campaign_total_sessions", "campaign_severity")


@query("first_public_ips")
def q_first_public_ips(spark, sf_dir):
    """The first 20 distinct public IPs by appearance (the lookup cap)."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    return G.first_public_ips(s, 20)


# ---------------------------------------------------------------- enrichment and dashboard


@query("enriched_rule")
def q_enriched_rule(spark, sf_dir):
    """L1 + S14 with stand-in model columns instead of the model stages: all 49 columns."""
    e = rule_enriched(spark, sf_dir)
    dbl = [f.name for f in e.schema.fields if f.dataType.typeName() == "double"]
    e = _text_times(e)
    return e.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in e.columns])


@query("enriched_rule_batched")
def q_enriched_rule_batched(spark, sf_dir):
    """L1 with per-upload-batch statistics (batches of 200): z-scores, cluster
    labels / weights and campaigns per batch; stand-in model columns."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    e = enrich(s, fixtures.geo_ranges(spark, sf_dir), clusterer=fixtures.rule_models, with_ml=False,
               with_pca=False, scope_cols=["batch_id"], batch_size=QUERY_BATCH, materialize_output=False)
    dbl = [f.name for f in e.schema.fields if f.dataType.typeName() == "double"]
    e = _text_times(e)
    return e.select(*[r6(c).alias(c) if c in dbl else F.col(c) for c in e.columns])


@query("enriched_per_batch")
def q_enriched_per_batch(spark, sf_dir):
    """L1 + M3-M7 + M16, the reference's run: every upload batch has its own k-means (k by the
    silhouette), stability, isolation forest, z-scores, labels, weights and campaigns."""
    s = sessions(spark, sf_dir, keep_order_cols=True)
    df = enrich(s, fixtures.geo_ranges(spark, sf_dir), clusterer=models_per_batch, with_ml=False, with_pca=False,
                scope_cols=["batch_id"], batch_size=QUERY_BATCH, materialize_output=False)
    return df.select("session_id", "session", "seg", "batch_id", "behavior_cluster", "behavior_label", "is_anomaly", "dbscan_label",
                     r6("cluster_stability").alias("cluster_stability"), r6("risk_score").alias("risk_score"), "risk_level",
                     "campaign_severity", "attacker_type")


@query("dashboard_view")
def q_dashboard_view(spark, sf_dir):
    """L2: renames, coercions, 0-100 risk, predicted level/score, fallbacks."""
    d = rule_dashboard(spark, sf_dir)
    return d.select("session_id", "ip_address", "events_count", "duration", "cluster",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                    "is_anomaly", "high_event_activity", "long_session", "credential_guessing", "command_heavy",
                    r6("risk_score").alias("risk_score"), r6("risk_score_raw").alias("risk_score_raw"),
                    "predicted_risk_level", "predicted_risk_score", "lat", "lon", "velocity_score",
                    "bytes_transferred")


@query("risk_100")
def q_risk_100(spark, sf_dir):
    """Z-score risk mapped to 0-100 (clamp -2..5)."""
    d = rule_dashboard(spark, sf_dir)
    return d.select("session_id", r6("risk_score_raw").alias("risk_score_raw"), r6("risk_score").alias("risk_score"))


@query("score_bands")
def q_score_bands(spark, sf_dir):
    """Label and colour bands of the scores."""
    d = rule_dashboard(spark, sf_dir)
    return d.select("session_id", L.zscore_label("risk_score_raw").alias("zscore_label"),
                    L.risk_band3("risk_score").alias("marker_band"),
                    L.ml_risk_band(F.col("risk_score") / 100.0).alias("ml_band"),
                    L.stability_band("cluster_stability").alias("stability_band"))


@query("risk_histogram")
def q_risk_histogram(spark, sf_dir):
    """20 fixed bins on the 0-100 risk, zero bins included."""
    return R.risk_histogram(rule_dashboard(spark, sf_dir))


@query("risk_histogram_remap")
def q_risk_histogram_remap(spark, sf_dir):
    """A13 with the reference's second 0-100 mapping of the risk."""
    return R.risk_histogram(rule_dashboard(spark, sf_dir), remap=True)


@query("daily_activity")
def q_daily_activity(spark, sf_dir):
    """A10 + J5: zero-filled day series of all and high-risk sessions."""
    return R.daily_activity(rule_dashboard(spark, sf_dir))


@query("kpis")
def q_kpis(spark, sf_dir):
    """A11 + S11: overview KPIs (metrics fall back to the stored columns)."""
    d = rule_dashboard(spark, sf_dir)
    return R.kpis(d, D.resolve_metrics(d))


@query("top_risk")
def q_top_risk(spark, sf_dir):
    """O2: ten highest-risk high-level sessions."""
    t = R.top_risk(rule_dashboard(spark, sf_dir))
    return t.withColumn("risk_score", r6("risk_score"))


@query("first_anomalies")
def q_first_anomalies(spark, sf_dir):
    """O3: the first 20 anomalous sessions in stored order."""
    return R.first_anomalies(rule_dashboard(spark, sf_dir)).select("session_id", r6("risk_score").alias("risk_score"), "predicted_risk_level")


@query("risk_by_cluster")
def q_risk_by_cluster(spark, sf_dir):
    """Mean 0-100 risk per cluster."""
    return R.risk_by_cluster(rule_dashboard(spark, sf_dir)).withColumn("mean_risk", r6("mean_risk"))


@query("attack_vector")
def q_attack_vector(spark, sf_dir):
    """Mean attack-vector features with the report's scaling."""
    return R.attack_vector(rule_dashboard(spark, sf_dir)).withColumn("value", r6("value"))


@query("risk_factors")
def q_risk_factors(spark, sf_dir):
    """Risk-factor shares of 100 %."""
    return R.risk_factors(rule_dashboard(spark, sf_dir)).withColumn("share", r6("share"))


@query("distributions")
def q_distributions(spark, sf_dir):
    """A8 + A9: level, archetype, severity, attacker type distributions in one scan."""
    d = rule_dashboard(spark, sf_dir)
    return R.distributions(d, ["predicted_risk_level", "threat_archetype", "campaign_severity", "attacker_type"])


@query("archetype_top5")
def q_archetype_top5(spark, sf_dir):
    """A8 top-k: five most frequent threat archetypes."""
    return R.distribution(rule_dashboard(spark, sf_dir), "threat_archetype", 5)


@query("risk_level_share")
def q_risk_level_share(spark, sf_dir):
    """A8 + A24: risk-level distribution with % share of the total."""
    return R.with_share(R.distribution(rule_dashboard(spark, sf_dir), "predicted_risk_level"))


@query("cluster_profiles")
def q_cluster_profiles(spark, sf_dir):
    """A16 + A23: per-cluster report profile and its radar normalisation."""
    p = R.profile_radar(R.cluster_profiles(rule_dashboard(spark, sf_dir)))
    return p.select(*[r6(c).alias(c) if c not in ("cluster", "count") else F.col(c) for c in p.columns])


@query("stability_report")
def q_stability_report(spark, sf_dir):
    """A17 + A18: stability per cluster and the overall value (>= 0 only, else 0)."""
    d = rule_dashboard(spark, sf_dir)
    return with_scalars(R.stability_by_cluster(d), D.overall_stability(d))


@query("country_risk")
def q_country_risk(spark, sf_dir):
    """Mean 0-100 risk per country over public IPs, top 20."""
    return R.country_risk(rule_dashboard(spark, sf_dir)).withColumn("mean_risk", r6("mean_risk"))


@query("top_asns")
def q_top_asns(spark, sf_dir):
    """A8 (ASN): ten most frequent ASNs over public IPs."""
    return R.top_asns(rule_dashboard(spark, sf_dir))


@query("internal_top_ips")
def q_internal_top_ips(spark, sf_dir):
    """Ten private IPs with the highest mean risk."""
    return R.internal_top_ips(rule_dashboard(spark, sf_dir)).withColumn("score", r6("score"))


@query("internal_activity")
def q_internal_activity(spark, sf_dir):
    """Ten most active private IPs by events."""
    return R.internal_activity(rule_dashboard(spark, sf_dir))


@query("internal_summary")
def q_internal_summary(spark, sf_dir):
    """Private session count and their level distribution."""
    return R.internal_summary(rule_dashboard(spark, sf_dir))


@query("geo_points")
def q_geo_points(spark, sf_dir):
    """F4 + F5 + P34: public sessions with non-zero coordinates."""
    return R.geo_points(rule_dashboard(spark, sf_dir)).withColumn("risk_score", r6("risk_score"))


@query("batch_summary")
def q_batch_summary(spark, sf_dir):
    """Sessions, anomalies, high-threat rows per upload batch."""
    return R.batch_summary(rule_enriched(spark, sf_dir))


# ---------------------------------------------------------------- history and metrics


def _history_sessions(spark, sf_dir) -> DataFrame:
    return sessionize(fixtures.history_events(spark, sf_dir))


@query("new_sessions_anti")
def q_new_sessions_anti(spark, sf_dir):
    """S8 + J3 + U3: sessions not yet in the stored history (by session id)."""
    new = S.merge_new_sessions(sessions(spark, sf_dir), _history_sessions(spark, sf_dir), only_new=True)
    return _text_times(new)


@query("history_union")
def q_history_union(spark, sf_dir):
    """U1 + S8: stored history plus the new sessions, tagged by origin."""
    hist = _history_sessions(spark, sf_dir).withColumn("origin", F.lit("history"))
    merged = S.merge_new_sessions(sessions(spark, sf_dir).withColumn("origin", F.lit("new")), hist)
    return merged.select("session", "seg", "origin", "event_count")


def _scored(spark, sf_dir) -> DataFrame:
    return fixtures.scored(sessions(spark, sf_dir))


@query("binary_metrics")
def q_binary_metrics(spark, sf_dir):
    """Accuracy / precision / recall / F1 of score >= 0.5."""
    sc = _scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return M.binary_metrics(sc, "y", "pred")


@query("best_threshold")
def q_best_threshold(spark, sf_dir):
    """M12 + W5: F1-best threshold over the precision-recall curve, clamped."""
    b = M.best_threshold(_scored(spark, sf_dir), "y", "score")
    return b.select(r6("best_score").alias("best_score"), r6("best_f1").alias("best_f1"),
                    r6("threshold").alias("threshold"))


@query("stamp_metrics")
def q_stamp_metrics(spark, sf_dir):
    """S9 + S10: newest metrics record stamped on every stored session."""
    sc = _scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    metrics = M.binary_metrics(sc, "y", "pred")
    st = S.stamp_metrics(rule_enriched(spark, sf_dir), metrics)
    return st.select("session_id", "ml_accuracy", "ml_precision", "ml_recall")


@query("adjusted_rand")
def q_adjusted_rand(spark, sf_dir):
    """M8: adjusted Rand index of the rule clusters vs usernames mod 3."""
    c = fixtures.rule_clusters(sessions(spark, sf_dir)).withColumn("b", (F.col("unique_usernames") % 3).cast("int"))
    return C.adjusted_rand(c, "behavior_cluster", "b").select(r6("ari").alias("ari"))


@query("silhouette")
def q_silhouette(spark, sf_dir):
    """M4: squared-Euclidean silhouette of rule clusters on standardised features."""
    f = fixtures.rule_clusters(FE.standardize(flagged(spark, sf_dir), FE.CLUSTER_FEATURES))
    return C.silhouette(f, "behavior_cluster", [f"{c}_z" for c in FE.CLUSTER_FEATURES]).select(
        r6("silhouette").alias("silhouette"))


@query("silhouette_euclidean")
def q_silhouette_euclidean(spark, sf_dir):
    """M2 + M4 + J8: Euclidean silhouette of the rule clusters on a sample of 2,000 sessions."""
    f = fixtures.rule_clusters(FE.standardize(flagged(spark, sf_dir), FE.CLUSTER_FEATURES))
    return C.silhouette_euclidean(f, "behavior_cluster", [f"{c}_z" for c in FE.CLUSTER_FEATURES]).select(
        r6("silhouette").alias("silhouette"))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    """M9: per class the row count and the 30 % test share."""
    sc = _scored(spark, sf_dir)
    sp = M.stratified_split(sc, "y", 0.3, 42)
    return sp.groupBy("y").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


@query("csv_dashboard")
def q_csv_dashboard(spark, sf_dir):
    """S6 + S13 + L2: enriched sessions exported as CSV, loaded back with the
    enriched schema, turned into the dashboard view."""
    from ..schemas import ENRICHED
    from pyspark.sql import types as T
    path = shared_path(spark, f"csv/{uuid.uuid4().hex}")
    S.export_csv(rule_enriched(spark, sf_dir), path)
    schema = T.StructType(ENRICHED.fields + [T.StructField("seg", T.LongType()), T.StructField("batch_id", T.LongType())])
    d = D.prepare_dashboard(S.load_dashboard(spark, path, schema))
    return d.select("session_id", "ip_address", "events_count", "duration", "cluster",
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                    "is_anomaly", "high_event_activity", "long_session", "credential_guessing", "command_heavy",
                    r6("risk_score").alias("risk_score"), r6("risk_score_raw").alias("risk_score_raw"),
                    "predicted_risk_level", "predicted_risk_score", "lat", "lon", "velocity_score",
                    "bytes_transferred")


@query("metrics_record")
def q_metrics_record(spark, sf_dir):
    """S9 + S11: metrics record written as JSON, read back and resolved."""
    sc = _scored(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    path = shared_path(spark, f"metrics/{uuid.uuid4().hex}")
    S.write_metrics(M.binary_metrics(sc, "y", "pred"), path)
    return D.resolve_metrics(rule_enriched(spark, sf_dir), S.read_metrics(spark, path))


@query("archive_batches")
def q_archive_batches(spark, sf_dir):
    """S6 + S7: history written per batch (idempotent partition overwrite,
    risk-ordered), the rows of each batch archived; counts per batch."""
    base = shared_path(spark, f"history/{uuid.uuid4().hex}")
    e = rule_enriched(spark, sf_dir, materialize_output=True)
    S.write_sessions(e, f"{base}/history", mode="overwrite_batches")
    S.write_sessions(e, f"{base}/history", mode="overwrite_batches")  # a retried batch replaces itself
    S.archive_batch(e, f"{base}/archive")
    h = spark.read.parquet(f"{base}/history").groupBy("batch_id").agg(F.count(F.lit(1)).alias("history_rows"))
    a = spark.read.parquet(f"{base}/archive").groupBy("batch_id").agg(F.count(F.lit(1)).alias("archive_rows"))
    # Partition discovery infers the batch column's type; keep it BIGINT.
    return h.join(a, "batch_id", "full").withColumn("batch_id", F.col("batch_id").cast("bigint"))


@query("scatter_points")
def q_scatter_points(spark, sf_dir):
    """PCA and duration/events scatter points (NULL -> 0)."""
    d = rule_dashboard(spark, sf_dir)
    sc = R.scatter(d).withColumnRenamed("cluster", "scatter_cluster")
    de = R.duration_events(d)
    return sc.join(de, "session_id").select("session_id", "pca_x", "pca_y", "is_anomaly", "duration",
                                            "events_count", "cluster")


# ---------------------------------------------------------------- model stages (no SQL twin)


@query("kmeans_sessions")
def q_kmeans_sessions(spark, sf_dir):
    """M3 + M5 + A4: k chosen by silhouette over all rows, final k-means with
    canonical ids; cluster sizes and profiles."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.CLUSTER_FEATURES)
    zc = [f"{c}_z" for c in FE.CLUSTER_FEATURES]
    k, _, models = C.search_kmeans(f, zc)
    cl = materialize(C.cluster_sessions(f, min(k, C.FINAL_K_CAP), models=models), "clusters")
    prof = C.cluster_profile(cl)
    sizes = cl.groupBy("behavior_cluster").agg(F.count(F.lit(1)).alias("sessions"))
    return prof.join(sizes, "behavior_cluster")


@query("kmeans_invariants")
def q_kmeans_invariants(spark, sf_dir):
    """M3 + M5: what must hold of the clusters, whatever the seeds: they cover all sessions,
    ids count from 0 in the order of their mean risk, every session's centre (the mean of
    its cluster) is the nearest one for at least 99 % of them."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.CLUSTER_FEATURES)
    zc = [f"{c}_z" for c in FE.CLUSTER_FEATURES]
    k, _, models = C.search_kmeans(f, zc)
    cl = materialize(C.cluster_sessions(materialize(f, "scaled"), min(k, C.FINAL_K_CAP), models=models), "clusters")
    return C.cluster_invariants(cl, list(FE.CLUSTER_FEATURES))


@query("isolation_forest")
def q_isolation_forest(spark, sf_dir):
    """M6: isolation forest on standardised auth features, 10 % contamination."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    out = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES])
    return out.select("session", "seg", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "dbscan_label")


@query("isolation_forest_batched")
def q_isolation_forest_batched(spark, sf_dir):
    """M6 in L1: every upload batch has a forest and a quantile of its own, on features
    standardised within the batch; all of them in one job."""
    s = materialize(sessions(spark, sf_dir, keep_order_cols=True), "sessions")
    s = materialize(with_batch_ids(s, emission_order(), batch_size=QUERY_BATCH), "batches")
    f = FE.standardize(s, FE.AUTH_FEATURES, scope_cols=["batch_id"], suffix="_if")
    out = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES], group_cols=["batch_id"])
    return out.select("session", "seg", "batch_id", r6("anomaly_score").alias("anomaly_score"), "is_anomaly", "dbscan_label")


@query("anomaly_summary")
def q_anomaly_summary(spark, sf_dir):
    """Anomaly count and rate of the isolation forest."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    return R.anomaly_summary(isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES]))


@query("anomaly_invariants")
def q_anomaly_invariants(spark, sf_dir):
    """M6: what must hold of the forest's flags: at most the contamination share is
    flagged, and no flagged session scores above one that isn't."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    out = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES])
    g = out.agg(F.count(F.lit(1)).alias("sessions"), F.count_if("is_anomaly").alias("k"),
                F.max(F.when(F.col("is_anomaly"), F.col("anomaly_score"))).alias("worst"),
                F.min(F.when(~F.col("is_anomaly"), F.col("anomaly_score"))).alias("best"))
    return g.select("sessions", (F.col("k") <= 0.1 * F.col("sessions") + 1).alias("at_most_a_tenth"),
                    F.coalesce(F.col("worst") < F.col("best"), F.lit(True)).alias("lowest_scores"))


@query("risk_forest")
def q_risk_forest(spark, sf_dir):
    """M9-M14 + M17: forest on the anomaly labels; scores, bands, metrics."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    lab = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES]).drop(*[f"{c}_if" for c in FE.AUTH_FEATURES])
    out, _ = M.ml_risk(lab, model_path=shared_path(spark, f"models/{uuid.uuid4().hex}"))
    return out.select("session", "seg", "is_anomaly", "ml_risk_score", "ml_risk_label", "ml_accuracy",
                      "ml_precision", "ml_recall")


@query("risk_model_cumulative")
def q_risk_model_cumulative(spark, sf_dir):
    """M13 + M17: batch model scored on the sessions, metrics from the cumulative
    evaluation on the stored history, here all sessions (relabelled by the
    isolation forest, scaled with the batch scaler, retrained, held-out 30 %)."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    lab = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES]).drop(*[f"{c}_if" for c in FE.AUTH_FEATURES])
    out, metrics = M.ml_risk(lab, history=sessions_table(spark, sf_dir))
    rec = S.metrics_frame(spark, {**metrics, "eval_mode": metrics.get("eval_mode", "fallback")})
    per_label = out.groupBy("ml_risk_label").agg(F.count(F.lit(1)).alias("sessions"))
    return with_scalars(per_label, rec.select("eval_mode", "accuracy", "test_size"))


@query("risk_model_reloaded")
def q_risk_model_reloaded(spark, sf_dir):
    """S12 + M14 + P21: the saved model, loaded again, gives every session the score of
    the run that fitted it; scores lie in 0..1 and bands follow from them."""
    f = FE.standardize(sessions_table(spark, sf_dir), FE.AUTH_FEATURES, suffix="_if")
    lab = isolation_forest(f, [f"{c}_if" for c in FE.AUTH_FEATURES]).drop(*[f"{c}_if" for c in FE.AUTH_FEATURES])
    lab = materialize(lab, "labelled")
    path = shared_path(spark, f"models/{uuid.uuid4().hex}")
    out, metrics = M.ml_risk(lab, model_path=path)
    again = M.score_with_saved(lab, path).select("session", "seg", F.col("ml_risk_score").alias("again"))
    both = out.join(again, ["session", "seg"], "full")
    s = F.col("ml_risk_score")
    g = both.agg(F.count(F.lit(1)).alias("sessions"), F.count_if(s == F.col("again")).alias("same"),
                 F.count_if((s >= 0) & (s <= 1)).alias("within"), F.count_if(F.col("ml_risk_label") == L.ml_risk_band(s)).alias("band"),
                 F.count_if(F.col("ml_accuracy").between(0, 1)).alias("rated"))
    return g.select("sessions", *[(F.col(c) == F.col("sessions")).alias(n) for c, n in (
        ("same", "same_scores"), ("within", "scores_in_range"), ("band", "bands_follow"), ("rated", "accuracy_in_range"))])


@query("pca2")
def q_pca2(spark, sf_dir):
    """Two principal components of the standardised clustering features."""
    p = M.pca2(sessions_table(spark, sf_dir))
    return p.select("session", "seg", r6("pca_x").alias("pca_x"), r6("pca_y").alias("pca_y"))


@query("enriched_full")
def q_enriched_full(spark, sf_dir):
    """L1 complete: k-means, isolation forest, random forest and PCA."""
    return full_enriched(spark, sf_dir)


# ---------------------------------------------------------------- windows and streaming


@query("session_windows")
def q_session_windows(spark, sf_dir):
    """T4 (batch): per key, events less than 2 minutes apart form a window."""
    w = gap_sessions(fixtures.raw_events(spark, sf_dir), "2 minutes")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return w.select("session", F.date_format("window_start", fmt).alias("window_start"),
                    F.date_format("window_end", fmt).alias("window_end"), "events")


def _landed_log(spark, sf_dir, files: int = 8) -> str:
    """The raw events of the test tables landed as NDJSON log files."""
    path = shared_path(spark, f"logs/{uuid.uuid4().hex}")
    write_ndjson(fixtures.raw_events(spark, sf_dir), path, files)
    return path


@query("ndjson_sessions")
def q_ndjson_sessions(spark, sf_dir):
    """S1 + S3 + P3 + A1: the raw events landed as NDJSON logs, read back by the batch
    reader in arrival order and sessionized."""
    ev = read_events(spark, _landed_log(spark, sf_dir))
    return _text_times(sessionize(ev, seq="arrival", chunk="split"))


@query("stream_sessions")
def q_stream_sessions(spark, sf_dir):
    """T1-T3 + S2/S4/T7/T8: NDJSON log folder streamed in bounded triggers through
    the sessionizer, run to completion with availableNow; the sessions that
    closed and, flushed at the end, those still open."""
    log = _landed_log(spark, sf_dir)
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")

    def sink(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    stream_sessions(stream_events(spark, log, max_files_per_trigger=4), f"{base}/ckpt", sink)
    return _text_times(spark.read.parquet(f"{base}/out").drop("batch", "first_seq", "last_seq", "closed"))


@query("stream_growing_log")
def q_stream_growing_log(spark, sf_dir):
    """S2 + S3 + T1-T3 + T7: logs that begin, get lines appended and are rotated with lines
    unread, one run of the stream after each; what it has found at the end."""
    events, base = fixtures.raw_events(spark, sf_dir), shared_path(spark, f"stream/{uuid.uuid4().hex}")

    def sink(found: DataFrame, batch: int) -> None:
        found.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    for phase in range(4):
        write_growing_log(events, f"{base}/log", phase, phases=4)
        if phase != 2:  # appended lines that are still unread when the log is rotated
            stream_sessions(stream_growing_events(spark, f"{base}/log", order="path"), f"{base}/ckpt", sink, flush=phase == 3)
    return _text_times(spark.read.parquet(f"{base}/out").drop("batch", "first_seq", "last_seq", "closed"))


@query("stream_batches")
def q_stream_batches(spark, sf_dir):
    """S4 + P20 on the stream: upload batches of exactly N finished sessions, whatever the
    micro-batches; the rest waits, and is a batch of its own at the end."""
    log = _landed_log(spark, sf_dir)
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")
    queue = BatchQueue(spark, f"{base}/queue", QUERY_BATCH)

    def sink(found: DataFrame, batch: int) -> None:
        queue.push(found, batch, last=batch % 2 == 0).write.mode("overwrite").parquet(f"{base}/out/push={batch}")

    stream_sessions(stream_events(spark, log, max_files_per_trigger=3), f"{base}/ckpt", sink)
    return spark.read.parquet(f"{base}/out").select("session", "seg", "batch_id", "session_id")


@query("stream_session_window")
def q_stream_session_window(spark, sf_dir):
    """T4 streaming: gap windows over the log in bounded triggers; complete mode, so
    windows that are still open at the end of the log are there too."""
    log = _landed_log(spark, sf_dir)
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")
    sdf = gap_sessions(stream_events(spark, log, max_files_per_trigger=4), "2 minutes")
    stream_to_table(sdf, f"{base}/out", f"{base}/ckpt", mode="complete")
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    w = spark.read.parquet(f"{base}/out")
    return w.select("session", F.date_format("window_start", fmt).alias("window_start"),
                    F.date_format("window_end", fmt).alias("window_end"), "events")


@query("stream_daily_counts")
def q_stream_daily_counts(spark, sf_dir):
    """The stored enriched sessions read as a stream; tumbling one-day
    counts of all and high-threat sessions (complete mode: one row per day)."""
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")
    rule_enriched(spark, sf_dir).write.parquet(f"{base}/history")
    src = spark.readStream.schema(spark.read.parquet(f"{base}/history").schema).parquet(f"{base}/history")
    sdf = daily_counts(src.withColumn("high", F.col("risk_level") == "high"), high_col="high")
    stream_to_table(sdf, f"{base}/out", f"{base}/ckpt", mode="complete")
    return spark.read.parquet(f"{base}/out").withColumn("day_start", F.date_format("day_start", "yyyy-MM-dd"))


@query("stream_dedupe")
def q_stream_dedupe(spark, sf_dir):
    """T5: a log delivered twice (two copies of every file) deduplicated
    within the watermark; every event survives exactly once."""
    log = _landed_log(spark, sf_dir, files=4)
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")
    spark.read.text(log).write.text(f"{base}/in")
    spark.read.text(log).write.mode("append").text(f"{base}/in")
    ev = stream_events(spark, f"{base}/in")
    sdf = dedupe_events(ev, watermark="1 day").drop("split")
    stream_to_table(sdf, f"{base}/out", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("eventid").agg(F.count(F.lit(1)).alias("events"))


@query("incremental_history")
def q_incremental_history(spark, sf_dir):
    """L7 + T6 + S6/S8 + P20: log folder -> sessions -> per-batch enrichment (stand-in
    cluster rule, no model stages) -> history table; the stored sessions with
    their flags, and whether their ids are unique."""
    log = _landed_log(spark, sf_dir)
    base = shared_path(spark, f"stream/{uuid.uuid4().hex}")
    h = run_incremental(spark, log, f"{base}/history", f"{base}/ckpt", fixtures.geo_ranges(spark, sf_dir),
                        max_files_per_trigger=4, archive_path=f"{base}/archive",
                        enrich_kwargs={"clusterer": fixtures.rule_clusters, "with_ml": False, "with_pca": False})
    ids = h.agg(F.count_distinct("session_id").alias("distinct_ids"))
    return with_scalars(h.select("session", "seg", "src_ip", "event_count", "unique_commands", "failed_logins",
                                 "behavioral_risk_score", "country"), ids)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk-level distribution (with shares) of the fully enriched sessions."""
    d = D.prepare_dashboard(full_enriched(spark, sf_dir))
    return R.with_share(R.distribution(d, "predicted_risk_level"))
