"""Stand-in inputs built from the driver's test tables.

These only reshape given tables into the schemas the jobs expect (raw
honeypot events, an IP-range reference table, a stored-history key set).
They do none of the jobs' work: sessionizing, scoring, joining and
aggregating all happen in the operators on whatever rows arrive here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import EVENT_LOGIN_FAILED, EVENT_LOGIN_SUCCESS, EVENT_SESSION_CLOSED

# Event times are compressed 600x around this anchor so that session
# durations straddle the 60 s and 300 s thresholds.
ANCHOR_US = 1704067200000000  # 2024-01-01 00:00:00 UTC in microseconds
TIME_COMPRESSION = 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` table -> raw honeypot events (session, src_ip, eventid, ...).

    Columns: event_seq (arrival order), session, src_ip, eventid, timestamp
    (ISO-8601 text), input, username.
    """
    ev = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    k = F.get_json_object("props", "$.k").try_cast("int")
    comp_us = F.lit(ANCHOR_US) + F.expr(
        f"(unix_micros(CAST(ts AS TIMESTAMP)) - {ANCHOR_US}) div {TIME_COMPRESSION}")
    et = F.col("event_type")
    src_ip = F.when(
        uid % 5 == 0,
        F.concat(F.lit("10.0."), (uid % 7).cast("string"), F.lit("."), (uid % 250).cast("string")),
    ).otherwise(
        F.concat((F.lit(20) + uid % 150).cast("string"), F.lit("."), (uid % 200).cast("string"),
                 F.lit(".1."), (uid % 250).cast("string")))
    eventid = (F.when(et == "error", EVENT_LOGIN_FAILED).when(et == "signup", EVENT_LOGIN_SUCCESS)
               .when(et == "click", "cowrie.command.input").when(et == "view", "cowrie.session.connect")
               .otherwise(EVENT_SESSION_CLOSED))
    return ev.select(
        F.col("event_id").alias("event_seq"),
        F.concat(F.lit("s"), uid.cast("string")).alias("session"),
        src_ip.alias("src_ip"),
        eventid.alias("eventid"),
        F.date_format(F.timestamp_micros(comp_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(et == "click", F.concat(F.lit("cmd"), (k % 12).cast("string"))).alias("input"),
        F.when(et.isin("error", "signup"), F.concat(F.lit("user"), (k % 7).cast("string"))).alias("username"),
    )


def geo_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IP-range reference table (replaces the per-IP HTTP geo service).

    One /8 range per first octet 20-169 (octets divisible by 11 left out to
    exercise misses); country from `nation`.
    """
    nation = table(spark, sf_dir, "nation")
    octets = spark.range(20, 170).select(F.col("id").alias("o")).where(F.col("o") % 11 != 0)
    j = octets.join(nation, F.col("n_nationkey") == (F.col("o") % 25))
    return j.select(
        (F.col("o") * 16777216).cast("bigint").alias("ip_start"),
        (F.col("o") * 16777216 + 16777215).cast("bigint").alias("ip_end"),
        F.col("n_name").alias("country"),
        F.concat(F.lit("C"), F.lpad((F.col("o") % 25).cast("string"), 2, "0")).alias("country_iso"),
        F.concat(F.lit("City-"), F.col("o").cast("string")).alias("city"),
        (F.col("o") % 90).cast("double").alias("latitude"),
        (F.col("o") % 180).cast("double").alias("longitude"),
        F.concat(F.lit("AS"), (F.lit(64500) + F.col("o") % 40).cast("string"), F.lit(" Net "),
                 F.col("o").cast("string")).alias("as_text"),
    )


def nested_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that nest and overlap: those of ``geo_ranges`` and one a customer, of
    256 to 2 million addresses within the same first octets."""
    k = F.col("c_custkey")
    start = (20 + k % 150) * 16777216 + (k * 2027264) % 16777216
    wide = geo_ranges(spark, sf_dir).select("ip_start", "ip_end", "as_text")
    return wide.union(table(spark, sf_dir, "customer").select(
        start.cast("bigint"), (start + F.call_function("shiftleft", F.lit(256).cast("bigint"), (k % 14).cast("int")) - 1).cast("bigint"),
        F.concat(F.lit("customer "), k.cast("string"))))


def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events of a previously stored run: all events of users with user_id % 3 = 0."""
    ev = raw_events(spark, sf_dir)
    return ev.where(F.substring("session", 2, 20).cast("bigint") % 3 == 0)


def rule_clusters(df: DataFrame) -> DataFrame:
    """Stand-in cluster assignment for SQL-checkable runs (k-means is not
    expressible in SQL): events > 10 -> 2, duration > 60 s -> 1, else 0.
    The labelling, weighting and risk steps downstream are the engine's."""
    return df.withColumn(
        "behavior_cluster",
        F.when(F.col("event_count") > 10, 2).when(F.col("session_duration") > 60, 1).otherwise(0).cast("int"))


def rule_models(df: DataFrame) -> DataFrame:
    """``rule_clusters`` plus stand-in values in the other model columns, by fixed
    rules, so that everything that reads them can be checked by SQL."""
    n = F.col("event_count")
    return rule_clusters(df).withColumns({
        "is_anomaly": n % 7 == 0,
        "dbscan_label": F.when(n % 7 == 0, -1).otherwise(0).cast("int"),
        "cluster_stability": F.when(n > 10, 0.9).when(F.col("session_duration") > 60, 0.6).otherwise(-1.0),
        "ml_risk_score": (n % 10) / 10.0,
        "ml_risk_label": F.when(n % 10 > 7, "High Risk").when(n % 10 > 4, "Medium Risk").otherwise("Low Risk"),
        "ml_accuracy": F.lit(0.75), "ml_precision": F.lit(0.5), "ml_recall": F.lit(0.25),
        "pca_x": n / 4.0, "pca_y": F.when(n % 3 > 0, F.col("failed_logins") / 2.0),
    })


def scored(df: DataFrame) -> DataFrame:
    """Stand-in labels/scores for the metric operators: y = failed_logins > 1,
    score = (event_count * 37 mod 101) / 100."""
    return df.select(
        "session", "seg",
        (F.col("failed_logins") > 1).cast("int").alias("y"),
        ((F.col("event_count") * 37) % 101).cast("double").alias("_s"),
    ).withColumn("score", F.col("_s") / 100.0).drop("_s")
