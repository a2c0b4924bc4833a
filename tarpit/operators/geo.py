"""IP scope, geo enrichment by IP-range join (J4, P6, P8, P9), campaigns (A7,
P18, P19, J2).

Range join: Catalyst has no range-join operator (a BETWEEN join plans as a
nested loop). Ranges are exploded over the /``bits`` prefixes they cover and
equi-joined with the IPs on the prefix, then the BETWEEN residual filters;
the equi-join lets Spark pick a hash or sort-merge join by size. Only the
*distinct* public IPs are looked up, then mapped back to sessions, so a hot
IP costs one lookup; the join back is planned by AQE (broadcast when the
looked-up table is small at run time, skew-split sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ip as I
from ..functions import labels as L

GEO_COLS = ("country", "country_iso", "city", "latitude", "longitude", "asn", "asn_org")


def with_ip_scope(df: DataFrame, ip_col: str = "src_ip") -> DataFrame:
    """P6 column ``ip_scope``."""
    return df.withColumn("ip_scope", I.ip_scope(ip_col))


def bucket_ranges(ranges: DataFrame, bits: int = 16) -> DataFrame:
    """Explode each [ip_start, ip_end] range over the prefixes it covers."""
    shift = 32 - bits
    return ranges.withColumn(
        "_bucket", F.explode(F.sequence(F.shiftright("ip_start", shift), F.shiftright("ip_end", shift))))


def lookup_ips(ips: DataFrame, ranges: DataFrame, ip_col: str = "ip", bits: int = 16) -> DataFrame:
    """Distinct IP text -> best covering range (narrowest on overlap).

    Output: ``ip_col`` plus the range attributes; IPs without a covering
    range are absent (callers left-join).
    """
    shift = 32 - bits
    keyed = ips.select(ip_col).withColumn("_ipl", I.ipv4_to_long(ip_col)).where(F.col("_ipl").isNotNull())
    keyed = keyed.withColumn("_bucket", F.shiftright("_ipl", shift))
    b = bucket_ranges(ranges, bits)
    hits = (keyed.join(b, "_bucket")
            .where(F.col("_ipl").between(F.col("ip_start"), F.col("ip_end"))))
    attrs = [c for c in ranges.columns if c not in ("ip_start", "ip_end")]
    best = F.max_by(F.struct(*attrs), F.struct(F.col("ip_start"), -F.col("ip_end")))
    return hits.groupBy(ip_col).agg(best.alias("_r")).select(ip_col, *[F.col(f"_r.{a}").alias(a) for a in attrs])


def first_public_ips(df: DataFrame, n: int, ip_col: str = "src_ip", order_col: str = "first_seq") -> DataFrame:
    """The first ``n`` distinct public IPs by appearance (a top-n report)."""
    pub = df.where(I.ip_scope(ip_col) == "public")
    return (pub.groupBy(ip_col).agg(F.min(order_col).alias("_first"))
            .orderBy("_first", ip_col).limit(n).select(ip_col))


def geo_enrich(df: DataFrame, ranges: DataFrame, ip_col: str = "src_ip", bits: int = 16) -> DataFrame:
    """J4 + P8 + P9: attach country, country_iso, city, latitude, longitude,
    asn, asn_org.

    Private scope -> Internal/INT/Internal with NULL coordinates; public IPs
    with a covering range -> its attributes (asn/org split from the AS text);
    all others -> 'unknown' with NULL coordinates. Every distinct public IP is
    looked up.
    """
    scope = I.ip_scope(ip_col)
    ips = df.where(scope == "public").select(ip_col).distinct()
    found = lookup_ips(ips.withColumnRenamed(ip_col, "_gip"), ranges, "_gip", bits)
    found = found.select(
        "_gip",
        F.coalesce("country", F.lit("unknown")).alias("_country"),
        F.coalesce("country_iso", F.lit("unknown")).alias("_country_iso"),
        F.coalesce("city", F.lit("unknown")).alias("_city"),
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
        I.asn_number(F.coalesce("as_text", F.lit("unknown unknown"))).alias("_asn"),
        I.asn_org(F.coalesce("as_text", F.lit("unknown unknown"))).alias("_asn_org"),
        F.lit(True).alias("_hit"),
    )
    j = df.join(found, df[ip_col] == found["_gip"], "left")
    private = scope == "private"
    hit = F.coalesce(F.col("_hit"), F.lit(False))

    def pick(priv_val, hit_col):
        return F.when(private, F.lit(priv_val)).when(hit, F.col(hit_col)).otherwise(F.lit("unknown"))

    return (j.withColumn("country", pick("Internal", "_country"))
            .withColumn("country_iso", pick("INT", "_country_iso"))
            .withColumn("city", pick("Internal", "_city"))
            .withColumn("latitude", F.when(~private & hit, F.col("_lat")).cast("double"))
            .withColumn("longitude", F.when(~private & hit, F.col("_lon")).cast("double"))
            .withColumn("asn", pick("unknown", "_asn"))
            .withColumn("asn_org", pick("unknown", "_asn_org"))
            .drop("_gip", "_country", "_country_iso", "_city", "_lat", "_lon", "_asn", "_asn_org", "_hit"))


def campaigns(df: DataFrame, scope_cols=None) -> DataFrame:
    """A7 + P18 + P19: one row per campaign key (country_iso + '_' + asn),
    per scope when given.

    Partial aggregation per task before the shuffle keeps a hot campaign
    key cheap.
    """
    keyed = df.withColumn("campaign_key", L.campaign_key())
    g = keyed.groupBy(*(scope_cols or []), "campaign_key").agg(
        F.count("session").alias("campaign_total_sessions"),
        F.avg(F.col("event_count").cast("double")).alias("campaign_avg_event_count"),
        F.avg(F.col("unique_commands").cast("double")).alias("campaign_avg_unique_cmds"),
        F.sum(F.col("high_event_activity").cast("bigint")).alias("campaign_high_activity"),
        F.sum(F.col("command_heavy").cast("bigint")).alias("campaign_command_heavy"),
    )
    return g.withColumn("campaign_severity", L.campaign_severity())


def campaign_join(df: DataFrame, camp: DataFrame | None = None, scope_cols=None) -> DataFrame:
    """Attach campaign_key, campaign_total_sessions, campaign_severity."""
    camp = campaigns(df, scope_cols) if camp is None else camp
    keys = [*(scope_cols or []), "campaign_key"]
    keyed = df.withColumn("campaign_key", L.campaign_key())
    return keyed.join(camp.select(*keys, "campaign_total_sessions", "campaign_severity"), keys, "left")
