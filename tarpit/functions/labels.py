"""Flags, labels and bands (P10-P27, P35, P36, F2) as column expressions.

pandas compares NULL as *false*; every comparison feeding a flag is wrapped
in ``coalesce(..., false)`` to keep that behaviour.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gt(c, k) -> Column:
    """NULL-safe 'greater than' with pandas semantics (NULL -> false)."""
    return F.coalesce(_c(c) > F.lit(k), F.lit(False))


# Fixed thresholds of the reference.
HIGH_EVENTS = 10          # event_count > 10
LONG_SESSION_S = 60       # session_duration > 60 s
COMMAND_HEAVY = 5         # unique_commands > 5
THREAT_LONG_S = 300       # threat level uses duration > 300 s


def high_event_activity(c="event_count") -> Column:
    return gt(c, HIGH_EVENTS)


def long_session(c="session_duration") -> Column:
    return gt(c, LONG_SESSION_S)


def command_heavy(c="unique_commands") -> Column:
    return gt(c, COMMAND_HEAVY)


def credential_guessing(c="failed_logins") -> Column:
    """Any failed login (absent counter counts as 0)."""
    return gt(F.coalesce(_c(c), F.lit(0)), 0)


def behavioral_risk_score(a="high_event_activity", b="long_session", c="command_heavy") -> Column:
    """Number of the three fixed flags that hold (0-3)."""
    return (_c(a).cast("int") + _c(b).cast("int") + _c(c).cast("int")).cast("int")


def zscore_label(c="risk_score") -> Column:
    """> 2 High Risk, > 0 Medium Risk, else Low Risk."""
    return (F.when(gt(c, 2), "High Risk").when(gt(c, 0), "Medium Risk").otherwise("Low Risk"))


def threat_level(event_count="event_count", duration="session_duration",
                 commands="unique_commands", behavior_label=None, is_anomaly=None) -> Column:
    """low/medium/high from three thresholds; promotions to high first."""
    score = (gt(event_count, HIGH_EVENTS).cast("int") + gt(duration, THREAT_LONG_S).cast("int")
             + gt(commands, COMMAND_HEAVY).cast("int"))
    base = F.when(score >= 3, "high").when(score == 2, "medium").otherwise("low")
    promote = F.lit(False)
    if behavior_label is not None:
        promote = promote | F.coalesce(_c(behavior_label) == "High Risk", F.lit(False))
    if is_anomaly is not None:
        promote = promote | F.coalesce(_c(is_anomaly) == F.lit(True), F.lit(False))
    return F.when(promote, "high").otherwise(base)


# Cluster id -> (attacker_type, threat_archetype, confidence).
CLUSTER_THREAT_MAP = {
    0: ("Low Automation", "Reconnaissance / Noise", "Medium"),
    1: ("Brute Force Bot", "Credential Stuffing", "High"),
    2: ("Manual Attacker", "Interactive Exploration", "High"),
    3: ("Scanner", "Wide Network Scan", "Medium"),
    4: ("Unknown Pattern", "Anomalous Behavior", "Low"),
}
CLUSTER_THREAT_DEFAULT = ("Unclassified", "Unknown", "Low")


def cluster_threat(cluster="behavior_cluster", field: int = 0) -> Column:
    """One field of the fixed cluster -> threat mapping (map literal)."""
    m = F.create_map(*[x for k, v in CLUSTER_THREAT_MAP.items() for x in (F.lit(k), F.lit(v[field]))])
    return F.coalesce(F.try_element_at(m, _c(cluster).cast("int")), F.lit(CLUSTER_THREAT_DEFAULT[field]))


def cluster_threat_cols(cluster="behavior_cluster") -> dict[str, Column]:
    return {
        "attacker_type": cluster_threat(cluster, 0),
        "threat_archetype": cluster_threat(cluster, 1),
        "confidence_level": cluster_threat(cluster, 2),
    }


SOC_RELEVANCE = "behavioral_intelligence"


def geo_visualization(scope="ip_scope") -> Column:
    """P17: 'enabled' for public scope, else 'disabled'."""
    return F.when(F.coalesce(_c(scope) == "public", F.lit(False)), "enabled").otherwise("disabled")


def campaign_key(country_iso="country_iso", asn="asn") -> Column:
    """P18: '<country_iso>_<asn>' (missing parts print as 'None' like the reference)."""
    return F.concat(F.coalesce(_c(country_iso), F.lit("None")), F.lit("_"),
                    F.coalesce(_c(asn), F.lit("None")))


def campaign_severity(avg_events="campaign_avg_event_count", avg_cmds="campaign_avg_unique_cmds",
                      high="campaign_high_activity", heavy="campaign_command_heavy") -> Column:
    """Four tests; >= 3 high, 2 medium, else low."""
    s = (gt(avg_events, 10).cast("int") + gt(avg_cmds, 5).cast("int")
         + gt(high, 0).cast("int") + gt(heavy, 0).cast("int"))
    return F.when(s >= 3, "high").when(s == 2, "medium").otherwise("low")


def ml_risk_band(score="ml_risk_score") -> Column:
    """Clip to [0,1]; <= 0.3 Low, <= 0.7 Medium, else High; NULL -> Low."""
    s = F.least(F.greatest(_c(score), F.lit(0.0)), F.lit(1.0))
    return (F.when(s.isNull(), "Low Risk").when(s <= 0.3, "Low Risk")
            .when(s <= 0.7, "Medium Risk").otherwise("High Risk"))


def coerce_bool(c) -> Column:
    """Text TRUE/FALSE in any case; anything else -> false."""
    return F.coalesce(F.upper(_c(c).cast("string")) == "TRUE", F.lit(False))


# Day-first forms, after ISO text.
DAY_FIRST = ("dd-MM-yyyy HH:mm", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss",
             "dd/MM/yyyy", "dd.MM.yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy")


def dashboard_ts(c="timestamp") -> Column:
    """ISO text first, then the day-first forms; invalid -> NULL."""
    s = _c(c).cast("string")
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in DAY_FIRST])


def risk_to_100(c="risk_score") -> Column:
    """Z-score to 0-100: NULL -> 0, clamp [-2, 5], (x + 2) / 7 * 100."""
    x = F.least(F.greatest(_c(c).cast("double"), F.lit(-2.0)), F.lit(5.0))
    return F.when(_c(c).isNull() | F.isnan(_c(c).cast("double")), F.lit(0.0)).otherwise((x + 2.0) / 7.0 * 100.0)


def level_from_100(c="risk_score") -> Column:
    """P25 last branch: cut (0,33], (33,66], (66,100]; outside (incl. 0) -> Unknown."""
    x = _c(c)
    return (F.when((x > 0) & (x <= 33), "Low Risk").when((x > 33) & (x <= 66), "Medium Risk")
            .when((x > 66) & (x <= 100), "High Risk").otherwise("Unknown"))


def is_high(c="predicted_risk_level") -> Column:
    """level contains 'high' (case-insensitive); NULL -> false."""
    return F.coalesce(F.lower(_c(c)).contains("high"), F.lit(False))


def risk_band3(c="risk_score") -> Column:
    """Marker band > 80 red, > 50 amber, else teal."""
    return F.when(gt(c, 80), "red").when(gt(c, 50), "amber").otherwise("teal")


def stability_band(c="cluster_stability") -> Column:
    """> 0.8 high, > 0.5 medium, else low."""
    return F.when(gt(c, 0.8), "high").when(gt(c, 0.5), "medium").otherwise("low")
