"""Fixed schemas of the engine (the reference infers them from dict keys)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Raw honeypot event: only the fields the analytics read; list-valued fields
# are declared STRING so from_json keeps their JSON text (hashable, comparable).
RAW_EVENT = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("eventid", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("username", T.StringType()),
])

SESSIONS = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("seg", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("unique_commands", T.LongType()),
    T.StructField("session_duration", T.DoubleType()),
    T.StructField("failed_logins", T.LongType()),
    T.StructField("successful_login", T.LongType()),
    T.StructField("unique_usernames", T.LongType()),
    T.StructField("session_start", T.TimestampType()),
    T.StructField("session_end", T.TimestampType()),
])

GEO_RANGES = T.StructType([
    T.StructField("ip_start", T.LongType()),
    T.StructField("ip_end", T.LongType()),
    T.StructField("country", T.StringType()),
    T.StructField("country_iso", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("as_text", T.StringType()),
])

METRICS = T.StructType([
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("test_size", T.LongType()),
    T.StructField("anomaly_rate", T.DoubleType()),
    T.StructField("accuracy_at_50", T.DoubleType()),
    T.StructField("precision_at_50", T.DoubleType()),
    T.StructField("recall_at_50", T.DoubleType()),
    T.StructField("f1_at_50", T.DoubleType()),
    T.StructField("eval_mode", T.StringType()),
])

# The 49 output columns of the enrichment, in their published order.
ENRICHED = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("session", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("session_start", T.TimestampType()),
    T.StructField("session_end", T.TimestampType()),
    T.StructField("event_count", T.LongType()),
    T.StructField("unique_commands", T.LongType()),
    T.StructField("session_duration", T.DoubleType()),
    T.StructField("failed_logins", T.LongType()),
    T.StructField("successful_login", T.LongType()),
    T.StructField("unique_usernames", T.LongType()),
    T.StructField("high_event_activity", T.BooleanType()),
    T.StructField("long_session", T.BooleanType()),
    T.StructField("credential_guessing", T.BooleanType()),
    T.StructField("command_heavy", T.BooleanType()),
    T.StructField("behavioral_risk_score", T.IntegerType()),
    T.StructField("event_count_norm", T.DoubleType()),
    T.StructField("unique_commands_norm", T.DoubleType()),
    T.StructField("session_duration_norm", T.DoubleType()),
    T.StructField("behavior_cluster", T.IntegerType()),
    T.StructField("behavior_label", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("dbscan_label", T.IntegerType()),
    T.StructField("cluster_stability", T.DoubleType()),
    T.StructField("attacker_type", T.StringType()),
    T.StructField("threat_archetype", T.StringType()),
    T.StructField("confidence_level", T.StringType()),
    T.StructField("ip_scope", T.StringType()),
    T.StructField("risk_level", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("country_iso", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("asn", T.StringType()),
    T.StructField("asn_org", T.StringType()),
    T.StructField("campaign_key", T.StringType()),
    T.StructField("campaign_total_sessions", T.LongType()),
    T.StructField("campaign_severity", T.StringType()),
    T.StructField("ml_risk_score", T.DoubleType()),
    T.StructField("ml_risk_label", T.StringType()),
    T.StructField("ml_accuracy", T.DoubleType()),
    T.StructField("ml_precision", T.DoubleType()),
    T.StructField("ml_recall", T.DoubleType()),
    T.StructField("geo_visualization", T.StringType()),
    T.StructField("soc_relevance", T.StringType()),
    T.StructField("pca_x", T.DoubleType()),
    T.StructField("pca_y", T.DoubleType()),
])


def conform(df: DataFrame, schema: T.StructType, keep_extra: tuple[str, ...] = ()) -> DataFrame:
    """Add missing columns as typed NULLs and project in schema order."""
    present = set(df.columns)
    cols = [
        (F.col(f.name).cast(f.dataType) if f.name in present
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    cols += [F.col(c) for c in keep_extra if c in present and c not in schema.names]
    return df.select(*cols)
