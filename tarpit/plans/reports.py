"""Report queries over the dashboard view.

Each report is a lazy DataFrame. Global reports are a single aggregate
pass; top-k lists use ``orderBy().limit(k)`` (TakeOrderedAndProject: k rows
per task); ties always end in a unique key so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ip as I
from ..functions import labels as L
from ..functions.keys import session_number
from ..operators.common import with_scalars

HIST_BINS, HIST_LO, HIST_HI = 20, 0.0, 100.0


def distribution(df: DataFrame, col: str, k: int | None = None, where: Column | None = None,
                 name: str = "sessions") -> DataFrame:
    """Frequency of ``col`` (NULLs excluded) descending, optional top-k."""
    src = df if where is None else df.where(where)
    g = src.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
    if k is not None:
        g = g.orderBy(F.col(name).desc(), F.col(col).asc()).limit(k)
    return g


def distributions(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """Several one-column distributions in one scan.

    Unpivot to (dimension, value) and count; top-k per dimension runs over
    the aggregated rows only. Output: dimension, value, sessions, rank.
    """
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "dimension", "value")
    g = long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("sessions"))
    w = Window.partitionBy("dimension").orderBy(F.col("sessions").desc(), F.col("value").asc())
    g = g.withColumn("rank", F.row_number().over(w).cast("bigint"))
    return g.where(F.col("rank") <= k) if k is not None else g


def kpis(dash: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sessions, high-risk, anomalies, distinct countries (NULL not
    counted; 'Internal'/'unknown' count as countries), model accuracy."""
    g = dash.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(L.is_high("predicted_risk_level")).alias("high_risk_count"),
        F.count_if(F.col("is_anomaly")).alias("anomalies_detected"),
        F.count_distinct("country").alias("countries_count"),
    )
    return with_scalars(g, metrics.select(F.col("accuracy").alias("model_accuracy")))


def daily_activity(dash: DataFrame, ts: str = "timestamp", level: str = "predicted_risk_level") -> DataFrame:
    """A10 + J5: per day from the first to the last day: total and high-risk
    sessions, zero-filled. Output: day ('yyyy-MM-dd'), total, high_risk."""
    d = dash.select(F.to_date(F.col(ts)).alias("_d"), L.is_high(level).alias("_h")).where(F.col("_d").isNotNull())
    per = d.groupBy("_d").agg(F.count(F.lit(1)).alias("total"), F.count_if("_h").alias("high_risk"))
    bounds = d.agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    spine = bounds.select(F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("_d"))
    j = spine.join(per, "_d", "left")
    return j.select(F.date_format("_d", "yyyy-MM-dd").alias("day"),
                    F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
                    F.coalesce("high_risk", F.lit(0)).cast("bigint").alias("high_risk"))


def top_risk(dash: DataFrame, k: int = 10) -> DataFrame:
    """O2: top-k high-risk sessions by 0-100 risk (ties by session_id)."""
    cols = ["session_id", "risk_score", "predicted_risk_level"] + [
        c for c in ("ip_address", "country", "attacker_type", "threat_archetype", "behavior_label") if c in dash.columns]
    return (dash.where(L.is_high("predicted_risk_level"))
            .orderBy(F.col("risk_score").desc(), session_number(), F.col("session_id")).limit(k).select(*cols))


def risk_by_cluster(dash: DataFrame) -> DataFrame:
    """Mean 0-100 risk per cluster (NULL cluster dropped)."""
    return (dash.where(F.col("cluster").isNotNull()).groupBy("cluster")
            .agg(F.avg("risk_score").alias("mean_risk")))


def risk_histogram(dash: DataFrame, col: str = "risk_score", bins: int = HIST_BINS, lo: float = HIST_LO,
                   hi: float = HIST_HI, remap: bool = False) -> DataFrame:
    """Fixed-width histogram on [lo, hi] (last bin closed), all bins
    present. ``remap=True`` maps the (already 0-100) score through the 0-100
    map a second time, as the reference's risk report does."""
    x = F.col(col).cast("double")
    if remap:
        x = L.risk_to_100(x)
    width = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = (x >= lo) & (x <= hi)
    counts = dash.select(b.alias("bin"), inside.alias("_in")).where("_in").groupBy("bin").agg(
        F.count(F.lit(1)).alias("sessions"))
    spine = dash.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    label = F.concat((F.col("bin") * F.lit(width) + F.lit(lo)).cast("int").cast("string"), F.lit("-"),
                     ((F.col("bin") + 1) * F.lit(width) + F.lit(lo)).cast("int").cast("string"))
    return (spine.join(F.broadcast(counts), "bin", "left")
            .select("bin", label.alias("label"), F.coalesce("sessions", F.lit(0)).cast("bigint").alias("sessions")))


def _stacked(row_df: DataFrame, names: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {pairs}) AS (factor, value)")


def attack_vector(dash: DataFrame) -> DataFrame:
    """Mean failed logins, commands, duration/60, events/10, usernames."""
    g = dash.agg(
        F.avg(F.col("failed_logins").cast("double")).alias("Failed Logins"),
        F.avg(F.col("unique_commands").cast("double")).alias("Unique Commands"),
        (F.avg(F.col("duration").cast("double")) / 60).alias("Session Duration"),
        (F.avg(F.col("events_count").cast("double")) / 10).alias("Event Count"),
        F.avg(F.col("unique_usernames").cast("double")).alias("Unique Usernames"))
    return _stacked(g, ["Failed Logins", "Unique Commands", "Session Duration", "Event Count", "Unique Usernames"])


def risk_factors(dash: DataFrame) -> DataFrame:
    """Four scaled means as shares of 100 % (raw means if the total <= 0),
    sorted descending."""
    g = dash.agg(
        F.avg(F.col("events_count").cast("double")).alias("High Activity"),
        F.avg(F.col("unique_commands").cast("double")).alias("Command Diversity"),
        (F.avg(F.col("duration").cast("double")) / 10).alias("Session Duration"),
        F.avg(F.col("failed_logins").cast("double")).alias("Failed Logins"))
    s = _stacked(g, ["High Activity", "Command Diversity", "Session Duration", "Failed Logins"])
    tot = s.agg(F.sum("value").alias("_t"))
    j = with_scalars(s, tot)
    share = F.when(F.col("_t") > 0, F.col("value") / F.col("_t") * 100).otherwise(F.col("value"))
    return j.select("factor", share.alias("share")).orderBy(F.col("share").desc(), F.col("factor"))


def scatter(dash: DataFrame) -> DataFrame:
    """PCA scatter points, NULL -> 0."""
    cols = ["pca_x", "pca_y", "cluster", "session_id"] + (["is_anomaly"] if "is_anomaly" in dash.columns else [])
    return dash.select(*cols).na.fill(0, subset=["pca_x", "pca_y", "cluster"])


def duration_events(dash: DataFrame) -> DataFrame:
    """Duration vs events points, NULL -> 0."""
    return dash.select("duration", "events_count", "cluster", "session_id").na.fill(0, subset=["duration", "events_count", "cluster"])


def cluster_profiles(dash: DataFrame) -> DataFrame:
    """Per cluster mean duration, events, 0-100 risk, commands, failed
    logins and the session count (NULL cluster skipped)."""
    return (dash.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.avg(F.col("duration").cast("double")).alias("duration"),
        F.avg(F.col("events_count").cast("double")).alias("events_count"),
        F.avg("risk_score").alias("risk_score"),
        F.avg(F.col("unique_commands").cast("double")).alias("unique_commands"),
        F.avg(F.col("failed_logins").cast("double")).alias("failed_logins"),
        F.count(F.lit(1)).alias("count")))


def first_anomalies(dash: DataFrame, k: int = 20) -> DataFrame:
    """O3: the first k anomalous sessions in stored order: by batch, highest risk first."""
    batch = ["batch_id"] if "batch_id" in dash.columns else []
    return dash.where(F.col("is_anomaly")).orderBy(*batch, F.col("risk_score").desc_nulls_last(), session_number(), "session_id").limit(k)


def stability_by_cluster(dash: DataFrame) -> DataFrame:
    """Mean cluster_stability per cluster."""
    return dash.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(
        F.avg("cluster_stability").alias("stability"))


def with_private(dash: DataFrame) -> DataFrame:
    """P7 column ``is_private`` on the dashboard IP."""
    return dash.withColumn("is_private", I.is_private_ip("ip_address"))


def geo_points(dash: DataFrame) -> DataFrame:
    """F4 + F5 + P34: public sessions with coordinates (lat and lon != 0)."""
    d = with_private(dash)
    return (d.where(~F.col("is_private") & (F.col("lat") != 0) & (F.col("lon") != 0)
                    & F.col("lat").isNotNull() & F.col("lon").isNotNull())
            .select("lat", "lon", "country", "ip_address", "risk_score"))


def country_risk(dash: DataFrame, k: int = 20) -> DataFrame:
    """Mean 0-100 risk per country over public sessions, top k."""
    d = with_private(dash).where(~F.col("is_private") & F.col("country").isNotNull())
    return (d.groupBy("country").agg(F.avg("risk_score").alias("mean_risk"))
            .orderBy(F.col("mean_risk").desc(), F.col("country").asc()).limit(k))


def top_asns(dash: DataFrame, k: int = 10) -> DataFrame:
    """A8 (ASN): sessions per ASN over public sessions, top k."""
    return distribution(with_private(dash), "asn", k, where=~F.col("is_private"))


def internal_top_ips(dash: DataFrame, k: int = 10) -> DataFrame:
    """Private IPs by mean 0-100 risk, top k."""
    d = with_private(dash).where(F.col("is_private"))
    return (d.groupBy("ip_address").agg(F.avg("risk_score").alias("score"))
            .orderBy(F.col("score").desc(), F.col("ip_address").asc()).limit(k))


def internal_activity(dash: DataFrame, k: int = 10) -> DataFrame:
    """Private IPs by total events, top k."""
    d = with_private(dash).where(F.col("is_private"))
    return (d.groupBy("ip_address").agg(F.sum("events_count").cast("bigint").alias("events"))
            .orderBy(F.col("events").desc(), F.col("ip_address").asc()).limit(k))


def internal_summary(dash: DataFrame) -> DataFrame:
    """Private session count and their risk-level distribution in one
    pass: one row per level plus the total per row."""
    d = with_private(dash).where(F.col("is_private"))
    per = d.where(F.col("predicted_risk_level").isNotNull()).groupBy("predicted_risk_level").agg(
        F.count(F.lit(1)).alias("sessions"))
    tot = d.agg(F.count(F.lit(1)).alias("internal_sessions"))
    return with_scalars(per, tot)


def profile_radar(profiles: DataFrame, cols=("duration", "events_count", "risk_score", "unique_commands",
                                               "failed_logins")) -> DataFrame:
    """Each profile feature divided by its maximum over clusters (max 0 -> 1)."""
    mx = profiles.agg(*[F.max(c).alias(f"_mx_{c}") for c in cols])
    j = with_scalars(profiles, mx)
    for c in cols:
        j = j.withColumn(f"{c}_norm", F.col(c) / F.coalesce(F.nullif(F.col(f"_mx_{c}"), F.lit(0.0)), F.lit(1.0)))
    return j.drop(*[f"_mx_{c}" for c in cols])


def with_share(counts: DataFrame, n: str = "sessions") -> DataFrame:
    """Share of the total in %, one decimal."""
    tot = counts.agg(F.sum(n).alias("_t"))
    return with_scalars(counts, tot).withColumn("share", F.round(F.col(n) * 100.0 / F.col("_t"), 1)).drop("_t")


def anomaly_summary(df: DataFrame) -> DataFrame:
    """Anomaly count and rate (0 without sessions)."""
    return df.agg(F.count_if(F.col("is_anomaly")).alias("anomalies"),
                  F.count(F.lit(1)).alias("sessions")).withColumn(
        "anomaly_rate", F.coalesce(F.try_divide("anomalies", "sessions"), F.lit(0.0)))


def batch_summary(df: DataFrame) -> DataFrame:
    """Sessions, anomalies and high-threat rows per batch."""
    return df.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("anomalies"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk"))


# ---------------------------------------------------------------- report bundles


def overview_report(dash: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """L3: the KPI row."""
    return {"stats": kpis(dash, metrics)}


def risk_report(dash: DataFrame, metrics: DataFrame) -> dict[str, DataFrame]:
    """L4: distribution, day series, top sessions, cluster risk, histogram,
    attack vector, archetypes, campaign severity, risk factors, metrics."""
    return {
        "distribution": distribution(dash, "predicted_risk_level"),
        "time_series": daily_activity(dash),
        "top_risk_sessions": top_risk(dash),
        "risk_by_cluster": risk_by_cluster(dash),
        "risk_histogram": risk_histogram(dash, remap=True),
        "attack_vector": attack_vector(dash),
        "threat_archetype": distribution(dash, "threat_archetype", 5),
        "campaign_analysis": distribution(dash, "campaign_severity"),
        "risk_factors": risk_factors(dash),
        "metrics": metrics,
    }


def behavioral_report(dash: DataFrame) -> dict[str, DataFrame]:
    """Scatters, cluster profiles, anomalies, stability, anomaly types."""
    from .dashboard import overall_stability
    return {
        "scatter": scatter(dash),
        "duration_event_scatter": duration_events(dash),
        "profiles": cluster_profiles(dash),
        "silhouette": overall_stability(dash),
        "anomalies": first_anomalies(dash),
        "stability_plot": stability_by_cluster(dash),
        "anomaly_distribution": distribution(dash, "attacker_type", 5, where=F.col("is_anomaly")),
    }


def geo_report(dash: DataFrame) -> dict[str, DataFrame]:
    """Map points, country risk, ASNs, internal hosts."""
    return {
        "points": geo_points(dash),
        "country_risk": country_risk(dash),
        "top_asns": top_asns(dash),
        "internal_summary": internal_summary(dash),
        "internal_top_ips": internal_top_ips(dash),
        "internal_events_by_ip": internal_activity(dash),
    }
