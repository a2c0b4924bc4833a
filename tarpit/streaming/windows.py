"""Event-time windows: inactivity-gap sessions (T4) and tumbling day counts
(T9). The same functions work on batch and streaming DataFrames; on a
stream they need a watermark and run in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import parse_ts, session_hash, session_key


def gap_sessions(events: DataFrame, gap: str = "2 minutes", watermark: str | None = None) -> DataFrame:
    """T4: per session key, events closer than ``gap`` form one window.

    Output: session, window_start, window_end (last event + gap), events.
    Events are first merged inside (key, hour of the time), where a hot key is split
    by time; the merged fragments then form the windows, so what meets in one
    task of a key is a fragment per burst of events and hour, not an event.
    """
    ev = events.select(session_key("session", "src_ip").alias("_key"), parse_ts("timestamp").alias("ts"))
    ev = ev.where(F.col("ts").isNotNull())
    if watermark:
        ev = ev.withWatermark("ts", watermark)
    if ev.isStreaming:
        # merge inside the tasks before the exchange, so a hot key ships fragments
        ev.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        g = ev.groupBy("_key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    else:
        g = _merged(ev.groupBy("_key", F.date_trunc("hour", "ts").alias("_hour"), F.session_window("ts", gap).alias("w"))
                    .agg(F.count(F.lit(1)).alias("events")))
    return g.select(session_hash("_key").alias("session"), F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "events")


def _merged(fragments: DataFrame) -> DataFrame:
    """Fragments of one key that overlap become one window."""
    order = Window.partitionBy("_key").orderBy("w.start")
    reach = F.max("w.end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = fragments.withColumn("_new", F.coalesce(F.col("w.start") >= reach, F.lit(True)).cast("int"))
    numbered = starts.withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_key", "_no").agg(
        F.struct(F.min("w.start").alias("start"), F.max("w.end").alias("end")).alias("w"), F.sum("events").alias("events"))


def daily_counts(sessions: DataFrame, ts: str = "session_start", watermark: str | None = None,
                 high_col: str | None = None) -> DataFrame:
    """Tumbling one-day windows of session counts (and high-risk counts)."""
    s = sessions
    if watermark:
        s = s.withWatermark(ts, watermark)
    aggs = [F.count(F.lit(1)).alias("total")]
    if high_col:
        aggs.append(F.count_if(F.col(high_col)).alias("high_risk"))
    g = s.groupBy(F.window(ts, "1 day").alias("w")).agg(*aggs)
    return g.select(F.col("w.start").alias("day_start"), *[a for a in ("total", "high_risk") if a in g.columns])
