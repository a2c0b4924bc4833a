"""Behavioural features: fixed flags (P10-P12), median flags (A2), z-scores
(A3), standardisation (M1) and feature selection (P32, P33, M18).

Statistical operators take ``scope_cols``: ``None`` computes over the whole
DataFrame, ``["batch_id"]`` per upload batch (the reference's behaviour).
Whole-table statistics are one aggregate row attached as a scalar subquery,
never a ``Window.partitionBy()`` over everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L
from .common import materialize, with_scalars
from .select import quantile

CORE_COUNTERS = ("unique_usernames", "failed_logins", "successful_login")
CLUSTER_FEATURES = ("event_count", "unique_commands", "session_duration", "behavioral_risk_score")
INPUT_FEATURES = ("event_count", "unique_commands", "session_duration",
                  "failed_logins", "successful_login", "unique_usernames")
AUTH_FEATURES = ("failed_logins", "successful_login", "unique_usernames")

# Derived columns that must never be model inputs.
LEAKAGE_COLUMNS = frozenset({
    "behavioral_risk_score", "event_count_norm", "unique_commands_norm",
    "session_duration_norm", "behavior_cluster", "behavior_label",
    "cluster_stability", "is_anomaly", "dbscan_label", "risk_score",
    "risk_score_raw", "risk_level", "attacker_type", "threat_archetype",
    "ml_risk_score", "ml_risk_label", "ml_accuracy", "ml_precision",
    "ml_recall", "pca_x", "pca_y", "campaign_severity",
})


def attach_stats(df: DataFrame, stats: DataFrame, scope_cols=None) -> DataFrame:
    """Join per-scope statistics back; the whole-table case is a scalar subquery."""
    if not scope_cols:
        return with_scalars(df, stats)
    return df.join(stats, list(scope_cols), "left")


def _agg(df: DataFrame, exprs: list[Column], scope_cols=None) -> DataFrame:
    return df.groupBy(*scope_cols).agg(*exprs) if scope_cols else df.agg(*exprs)


def ensure_counters(df: DataFrame, cols=CORE_COUNTERS) -> DataFrame:
    """Absent counters default to 0 (FE step 1)."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0).cast("bigint"))
    return df


def behavior_flags(df: DataFrame) -> DataFrame:
    """Fixed-threshold flags, credential guessing and the 0-3 score."""
    df = ensure_counters(df)
    return (df.withColumn("high_event_activity", L.high_event_activity())
            .withColumn("long_session", L.long_session())
            .withColumn("command_heavy", L.command_heavy())
            .withColumn("credential_guessing", L.credential_guessing())
            .withColumn("behavioral_risk_score", L.behavioral_risk_score()))


def exact_median(df: DataFrame, col: str, out: str) -> DataFrame:
    """Exact interpolating median of ``col`` over the whole DataFrame (1 row, null without
    values), by refined histograms: no sort, see ``select``."""
    return df.sparkSession.range(1).select(F.lit(quantile(df, col, 0.5)).cast("double").alias(out))


def median_flags(df: DataFrame, scope_cols=None) -> DataFrame:
    """A2: event_count / session_duration above the (scope) median.

    Adds ``median_high_event_activity`` and ``median_long_session`` (the
    reference computes these first and then overwrites them with the fixed
    thresholds; both are kept as separate columns here).
    """
    if scope_cols:
        # Scopes are upload batches of bounded size: an exact per-group
        # percentile holds at most one batch of values.
        stats = _agg(df, [F.percentile(F.col("event_count").cast("double"), 0.5).alias("_med_e"),
                          F.percentile(F.col("session_duration"), 0.5).alias("_med_d")], scope_cols)
    else:
        own = materialize(df.select("event_count", "session_duration"), "median-values")  # read a few times
        stats = with_scalars(exact_median(own, "event_count", "_med_e"), exact_median(own, "session_duration", "_med_d"))
    out = attach_stats(df, stats, scope_cols)
    return (out.withColumn("median_high_event_activity",
                           F.coalesce(F.col("event_count") > F.col("_med_e"), F.lit(False)))
            .withColumn("median_long_session", F.coalesce(F.col("session_duration") > F.col("_med_d"), F.lit(False)))
            .drop("_med_e", "_med_d"))


def zscore(df: DataFrame, cols=("event_count", "unique_commands", "session_duration"),
           scope_cols=None, suffix: str = "_norm") -> DataFrame:
    """A3: (x - mean) / sample sd per scope; sd NULL or <= 0 -> 1."""
    exprs = []
    for c in cols:
        exprs += [F.avg(F.col(c).cast("double")).alias(f"_m_{c}"),
                  F.stddev_samp(F.col(c).cast("double")).alias(f"_s_{c}")]
    out = attach_stats(df, _agg(df, exprs, scope_cols), scope_cols)
    for c in cols:
        sd = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        out = out.withColumn(f"{c}{suffix}", (F.col(c).cast("double") - F.col(f"_m_{c}")) / sd)
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def scaler_stats(df: DataFrame, cols, scope_cols=None) -> DataFrame:
    """M1 fit: per-scope mean and population sd (NULL -> 0) of ``cols``."""
    exprs = []
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        exprs += [F.avg(x).alias(f"_m_{c}"), F.stddev_pop(x).alias(f"_s_{c}")]
    return _agg(df, exprs, scope_cols)


def apply_scaler(df: DataFrame, stats: DataFrame, cols, scope_cols=None, suffix: str = "_z") -> DataFrame:
    """M1 transform with given statistics; a constant column gives 0."""
    out = attach_stats(df, stats, scope_cols)
    for c in cols:
        sd = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        out = out.withColumn(f"{c}{suffix}", (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_m_{c}")) / sd)
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def standardize(df: DataFrame, cols, scope_cols=None, suffix: str = "_z") -> DataFrame:
    """M1: (x - mean) / population sd per scope; a constant column gives 0.

    NULLs count as 0 (features are filled first, as the reference does).
    """
    return apply_scaler(df, scaler_stats(df, cols, scope_cols), cols, scope_cols, suffix)


def fill_features(df: DataFrame, cols) -> DataFrame:
    """NULL -> 0 in feature columns (missing columns are created as 0)."""
    for c in cols:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0))
    return df.na.fill(0, subset=list(cols))


def cluster_features(df: DataFrame) -> DataFrame:
    """The four clustering features, NULL -> 0."""
    return fill_features(df, CLUSTER_FEATURES)


def prepare_features(df: DataFrame, features=INPUT_FEATURES, blocklist=LEAKAGE_COLUMNS) -> list[str]:
    """Whitelist check with a leak blocklist that raises; returns the
    available feature names (schema check only, no job)."""
    leaked = set(blocklist).intersection(features)
    if leaked:
        raise ValueError(f"derived columns must not be features: {sorted(leaked)}")
    return [c for c in features if c in df.columns]
