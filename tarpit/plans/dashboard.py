"""L2: enriched sessions -> the dashboard view (renames, coercions,
0-100 risk, predicted level/score, fallbacks) plus metrics resolution (S11)
and overall stability (A18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..functions.keys import session_number
from ..operators.common import with_scalars
from ..operators.ids import with_sequence_number

# Dashboard column names for enriched columns.
DASHBOARD_RENAMES = {
    "src_ip": "ip_address",
    "latitude": "lat",
    "longitude": "lon",
    "event_count": "events_count",
    "session_duration": "duration",
    "behavior_cluster": "cluster",
    "session_start": "timestamp",
}
BOOL_COLS = ("is_anomaly", "high_event_activity", "long_session", "credential_guessing", "command_heavy")
SYNTHETIC_TS_START = "2024-01-01 00:00:00"


def dashboard_names(df: DataFrame) -> DataFrame:
    """The seven renames (only for columns present)."""
    return df.withColumnsRenamed({k: v for k, v in DASHBOARD_RENAMES.items() if k in df.columns})


def prepare_dashboard(df: DataFrame) -> DataFrame:
    """L2 = P28, P22, P23, P24, P25, P26, P27, P31, P29, P30 in the reference's order."""
    df = dashboard_names(df)
    cols = set(df.columns)
    for c in BOOL_COLS:
        if c in cols:
            df = df.withColumn(c, L.coerce_bool(c))
    if "timestamp" in cols:
        ts_type = dict(df.dtypes)["timestamp"]
        if ts_type.startswith("timestamp"):
            df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        else:
            df = df.withColumn("timestamp", L.dashboard_ts("timestamp"))
    else:
        # No time column -> hourly from 2024-01-01 in stored order.
        order = [session_number(), "session_id"] if "session_id" in cols else df.columns[:1]
        df = with_sequence_number(df, order, "_rn")
        df = df.withColumn("timestamp", F.timestamp_add("HOUR", F.col("_rn"),
                                                        F.lit(SYNTHETIC_TS_START).cast("timestamp"))).drop("_rn")
    df = df.withColumn("risk_score_raw", F.col("risk_score")).withColumn("risk_score", L.risk_to_100("risk_score"))
    if "behavior_label" in cols:
        level = F.col("behavior_label")
    elif "ml_risk_label" in cols:
        level = F.col("ml_risk_label")
    else:
        level = L.level_from_100("risk_score")
    df = df.withColumn("predicted_risk_level", F.coalesce(level, F.lit("Unknown")))
    score = F.col("ml_risk_score") if "ml_risk_score" in cols else F.col("risk_score")
    df = df.withColumn("predicted_risk_score", score)
    if "is_anomaly" not in cols:
        df = df.withColumn("is_anomaly", L.is_high("predicted_risk_level"))
    if "pca_x" not in cols:
        df = df.withColumn("pca_x", F.col("risk_score_raw"))
    if "pca_y" not in cols:
        df = pca_fallback_y(df)
    for c in ("lat", "lon"):
        src = F.col(c).cast("string").try_cast("double") if c in cols else F.lit(None).cast("double")
        df = df.withColumn(c, F.coalesce(F.when(~F.isnan(src), src), F.lit(0.0)))
    for c in ("velocity_score", "bytes_transferred"):
        if c not in cols:
            df = df.withColumn(c, F.lit(0))
    return df


def pca_fallback_y(df: DataFrame) -> DataFrame:
    """pca_y = z-score of events_count with the sample sd (constant or single: NULL, as 0 / 0)."""
    st = df.agg(F.avg(F.col("events_count").cast("double")).alias("_m"),
                F.stddev_samp(F.col("events_count").cast("double")).alias("_s"))
    j = with_scalars(df, st)
    return j.withColumn("pca_y", F.try_divide(F.col("events_count") - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def resolve_metrics(df: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row accuracy/precision/recall: the metrics record if given,
    else the first stored row's ml_* columns (by session_id), else zeros."""
    spark = df.sparkSession
    if metrics is not None:
        return metrics.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                for c in ("accuracy", "precision", "recall")]).limit(1)
    if "ml_accuracy" in df.columns:
        first = df.orderBy(session_number(), "session_id").limit(1)
        return first.select(
            F.coalesce(F.col("ml_accuracy").cast("double"), F.lit(0.0)).alias("accuracy"),
            F.coalesce(F.col("ml_precision").cast("double"), F.lit(0.0)).alias("precision")
            if "ml_precision" in df.columns else F.lit(0.0).alias("precision"),
            F.coalesce(F.col("ml_recall").cast("double"), F.lit(0.0)).alias("recall")
            if "ml_recall" in df.columns else F.lit(0.0).alias("recall"))
    return spark.createDataFrame([(0.0, 0.0, 0.0)], "accuracy double, precision double, recall double")


def overall_stability(df: DataFrame) -> DataFrame:
    """Mean cluster_stability over values >= 0, else 0 (one row)."""
    if "cluster_stability" not in df.columns:
        return df.sparkSession.createDataFrame([(0.0,)], "silhouette double")
    c = F.col("cluster_stability")
    return df.agg(F.coalesce(F.avg(F.when(c >= 0, c)), F.lit(0.0)).alias("silhouette"))
