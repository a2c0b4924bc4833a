"""Batch sessionization: close-marker segmentation (W1) and the session aggregate (A1).

A key's events form one session until a ``session.closed`` event; later
events with the same key open the next segment. ``seg`` of an event is the
number of close markers of its key that arrived strictly before it.

Skew: a single key (events without session id fall back to the source IP or
'unknown') may hold a large share of all events. A window partitioned by the
key alone would put that share in one task, so events are dealt once, by
(key, chunk). There the close markers are counted and the events of each local
segment are aggregated to one piece, without another exchange. Only pieces
move on: the chunks' totals are summed up per key, and pieces of a session that
spans chunks are merged. Distinct values travel only for such sessions, a row each,
so a session of any length is counted in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import (EVENT_LOGIN_FAILED, EVENT_LOGIN_SUCCESS, EVENT_SESSION_CLOSED,
                              has_command, parse_ts, session_hash, session_key)
from .common import materialize

DEFAULT_CHUNK = 1 << 17


def _chunked(events: DataFrame, seq: str, chunk: str | None, chunk_size: int, keep=()) -> DataFrame:
    """Keyed events with ``_chunk`` and ``_local``, the close markers before each in its chunk."""
    kept = [F.col(c) for c in keep if c not in ("src_ip", "eventid", "input", "username")]
    ev = events.select(
        session_key("session", "src_ip").alias("_key"),
        F.col(seq).alias("_seq"),
        "src_ip", "eventid", "input", "username",
        parse_ts("timestamp").alias("_ts"),
        F.coalesce(F.col("eventid") == EVENT_SESSION_CLOSED, F.lit(False)).alias("_close"),
        (F.col(chunk) if chunk else F.floor(F.col(seq) / F.lit(chunk_size)).cast("bigint")).alias("_chunk"),
        *kept,
    )
    before = Window.partitionBy("_key", "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    return ev.withColumn("_local", F.coalesce(F.sum(F.col("_close").cast("bigint")).over(before), F.lit(0)))


def _offsets(totals: DataFrame) -> DataFrame:
    """``totals`` (_key, _chunk, _n) -> close markers of the key in earlier chunks."""
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_key", "_chunk", F.sum("_n").over(before).alias("_off")).where(F.col("_off") > 0)


def keyed_events(events: DataFrame, seq: str = "event_seq", chunk: str | None = None,
                 chunk_size: int = DEFAULT_CHUNK, keep=()) -> DataFrame:
    """Events with ``_key``, ``_seq``, ``_ts``, ``_close`` and ``seg``; ``keep`` names
    further columns of the events that stay."""
    ev = _chunked(events, seq, chunk, chunk_size, keep)
    offsets = _offsets(ev.groupBy("_key", "_chunk").agg(F.sum(F.col("_close").cast("bigint")).alias("_n")))
    return (ev.join(offsets, ["_key", "_chunk"], "left")
            .withColumn("seg", (F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
            .drop("_chunk", "_local", "_off"))


def _measures() -> list:
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.min("_ts").alias("session_start"),
        F.max("_ts").alias("session_end"),
        F.count_if(F.col("eventid") == EVENT_LOGIN_FAILED).alias("failed_logins"),
        F.count_if(F.col("eventid") == EVENT_LOGIN_SUCCESS).alias("successful_login"),
        F.min_by("src_ip", "_seq").alias("src_ip"),
        F.max(F.col("src_ip").isNotNull()).alias("_any_ip"),
        F.min("_seq").alias("first_seq"),
        F.max("_seq").alias("last_seq"),
        F.max("_close").alias("closed"),
    ]


def _session_row(g: DataFrame, keep_order_cols: bool, keep_key: bool) -> DataFrame:
    dur_us = F.unix_micros("session_end") - F.unix_micros("session_start")
    duration = (F.when(dur_us.isNull() | (dur_us == 0), F.col("event_count") * 5.0)
                .otherwise(dur_us / 1e6))
    cols = [
        session_hash("_key").alias("session"), "seg",
        F.when(F.col("_any_ip"), F.col("src_ip")).otherwise("unknown").alias("src_ip"),
        "event_count", "unique_commands",
        duration.cast("double").alias("session_duration"), "failed_logins", "successful_login",
        "unique_usernames", "session_start", "session_end",
    ]
    if keep_order_cols or keep_key:
        cols += ["first_seq", "last_seq", "closed"]
    return g.select(*cols, *(["_key"] if keep_key else []))


def aggregate_sessions(keyed: DataFrame, keep_key: bool = False) -> DataFrame:
    """A1 over ``keyed_events``: one row per (key, seg)."""
    g = keyed.groupBy("_key", "seg").agg(
        *_measures(), F.count_distinct(F.when(has_command("input"), F.col("input"))).alias("unique_commands"),
        F.count_distinct("username").alias("unique_usernames"))
    return _session_row(g, True, keep_key)


def session_pieces(events: DataFrame, seq: str = "event_seq", chunk: str | None = None,
                   chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """The part of each session that lies in one chunk: one scan and one exchange of the
    events, by (key, chunk), for the close-marker window and the aggregate alike."""
    command = F.when(has_command("input"), F.col("input"))
    return _chunked(events, seq, chunk, chunk_size).groupBy("_key", "_chunk", "_local").agg(
        *_measures(), F.collect_set(command).alias("_commands"), F.collect_set("username").alias("_usernames"))


def sessionize(events: DataFrame, seq: str = "event_seq", chunk_size: int = DEFAULT_CHUNK,
               keep_order_cols: bool = False, chunk: str | None = None) -> DataFrame:
    """A1: raw events -> one row per (session, seg).

    Columns: session (12-hex pseudonym of the key), seg, src_ip (first by
    arrival; 'unknown' if no event of the session has one), event_count,
    unique_commands (distinct non-blank input), session_duration (max - min of
    valid timestamps in seconds; 0 or no valid timestamp -> 5 * event_count),
    failed_logins, successful_login (a count), unique_usernames,
    session_start, session_end (TIMESTAMP). With ``keep_order_cols``:
    first_seq, last_seq, closed (emission order). ``chunk`` names a column
    that splits the events in arrival order (an input split); by default
    ``chunk_size`` numbers of ``seq`` are a chunk.
    """
    pieces = materialize(session_pieces(events, seq, chunk, chunk_size), "pieces")  # read by four branches below
    offsets = _offsets(pieces.groupBy("_key", "_chunk").agg(F.sum(F.col("closed").cast("bigint")).alias("_n")))
    # only the first piece of a chunk can continue a session, only an open one can be continued
    edge = (F.col("_local") == 0) | ~F.col("closed")
    placed = (pieces.join(offsets, ["_key", "_chunk"], "left")
              .withColumn("seg", (F.col("_local") + F.coalesce(F.col("_off"), F.lit(0))).cast("bigint"))
              .withColumn("_values", F.when(edge, F.concat(
                  F.transform("_commands", lambda v: F.struct(F.lit(0).alias("k"), v.alias("v"))),
                  F.transform("_usernames", lambda v: F.struct(F.lit(1).alias("k"), v.alias("v"))))))
              .withColumn("_nc", F.size("_commands").cast("bigint")).withColumn("_nu", F.size("_usernames").cast("bigint"))
              .drop("_commands", "_usernames"))
    whole = placed.groupBy("_key", "seg").agg(
        F.sum("event_count").alias("event_count"), F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"), F.sum("failed_logins").alias("failed_logins"),
        F.sum("successful_login").alias("successful_login"), F.min_by("src_ip", "first_seq").alias("src_ip"),
        F.max("_any_ip").alias("_any_ip"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
        F.max("closed").alias("closed"), F.count(F.lit(1)).alias("_pieces"), F.max("_nc").alias("_nc"), F.max("_nu").alias("_nu"))
    distinct = (placed.where(F.size("_values") > 0).select("_key", "seg", F.explode("_values").alias("x"))
                .groupBy("_key", "seg", F.col("x.k").alias("k"), F.col("x.v").alias("v")).agg(F.lit(1).alias("one"))
                .groupBy(F.col("_key").alias("_k"), F.col("seg").alias("_s")).agg(
                    F.count_if(F.col("k") == 0).alias("_dc"), F.count_if(F.col("k") == 1).alias("_du")))
    g = whole.join(distinct, (F.col("_key") == F.col("_k")) & (F.col("seg") == F.col("_s")) & (F.col("_pieces") > 1), "left")
    several = F.col("_pieces") > 1
    g = (g.withColumn("unique_commands", F.when(several, F.coalesce("_dc", F.lit(0))).otherwise(F.col("_nc")).cast("bigint"))
         .withColumn("unique_usernames", F.when(several, F.coalesce("_du", F.lit(0))).otherwise(F.col("_nu")).cast("bigint")))
    return _session_row(g, keep_order_cols, False)


def emission_order() -> list:
    """Order in which the reference emits sessions: closed ones at their close
    marker, then the ones still open at end of input by first appearance."""
    return [F.col("closed").desc(), F.when(F.col("closed"), F.col("last_seq"))
            .otherwise(F.col("first_seq")), F.col("session"), F.col("seg")]
