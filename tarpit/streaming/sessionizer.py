"""Streaming sessionization (T1-T3, T5): every micro-batch is a batch job over the
new events and what is still open.

The state between micro-batches is a written table in the shared folder: the
events of open sessions in arrival order, the next segment number of each key and
the largest event time. A batch numbers the segments of old and new events
together, emits the segments that have their close marker and writes the next
state. Nothing depends on a watermark, so late and untimed events are used where
they arrive, and a hot key is split as in the batch operator. A state is written
under the number of its batch, so a batch that is retried reads the same state
again and replaces what it wrote.

T2 / T3: with a ``gap``, an open session whose last event lies further back than
that behind the newest event is emitted (closed = false); its key's segment number
goes on. ``flush_open`` emits all that is open at the end of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import parse_ts
from ..operators.common import delete_path, list_names, materialize
from ..operators.sessionize import aggregate_sessions, keyed_events
from ..sources.events import with_arrival
from ..sources.sinks import read_or_none

EVENT_COLS = ("session", "src_ip", "eventid", "timestamp", "input", "username", "arrival", "split")


class SessionState:
    """Versions of the open sessions: batch n writes version 2n + 1, a flush after it 2n + 2."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, version: int, name: str) -> str:
        return f"{self.path}/version={version}/{name}"

    def before(self, batch_id: int) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
        """Open events, segment numbers and clock that batch ``batch_id`` starts from."""
        return self.load(2 * batch_id) or self.load(2 * batch_id - 1) or (None, None, None)

    def load(self, version: int):
        clock = read_or_none(self.spark, self._at(version, "clock"))  # written last
        if clock is None:
            return None
        return self.spark.read.parquet(self._at(version, "open")), self.spark.read.parquet(self._at(version, "next_seg")), clock

    def save(self, version: int, open_events: DataFrame, next_seg: DataFrame, clock: DataFrame) -> None:
        for name, df in (("open", open_events), ("next_seg", next_seg), ("clock", clock)):
            df.write.mode("overwrite").parquet(self._at(version, name))
        for old in (version - 3, version - 4):  # no retry reads them any more
            delete_path(self.spark, f"{self.path}/version={old}")

    def unflushed(self) -> int | None:
        """The last batch, if what it left open hasn't been flushed."""
        written = [int(n.split("=")[1]) for n in list_names(self.spark, self.path) if n.startswith("version=")]
        whole = [v for v in written if read_or_none(self.spark, self._at(v, "clock")) is not None]
        return (max(whole) - 1) // 2 if whole and max(whole) % 2 else None


def _with_base(sessions: DataFrame, next_seg: DataFrame | None) -> DataFrame:
    """Segment numbers counted from the key's first segment ever."""
    if next_seg is None:
        return sessions
    base = next_seg.select(F.col("_key").alias("_k"), F.col("next_seg"))
    return sessions.join(base, F.col("_key") == F.col("_k"), "left").withColumn(
        "seg", (F.col("seg") + F.coalesce("next_seg", F.lit(0))).cast("bigint")).drop("_k", "next_seg")


def session_batch(events: DataFrame, batch_id: int, state: SessionState, gap: str | None = None) -> DataFrame:
    """T1 for one micro-batch: the finished sessions, written once; saves the next state.

    ``events`` are those of a micro-batch of ``stream_events``; events of earlier
    batches come first whatever their files' times.
    """
    number = F.lit(batch_id).cast("bigint").alias("batch")
    new = with_arrival(events).withColumn("arrival", F.struct(number, F.col("arrival").alias("at"))).withColumn(
        "split", F.struct(number, F.col("split").alias("at"))).select(*EVENT_COLS)
    open_before, next_seg, clock = state.before(batch_id)
    ev = new if open_before is None else open_before.unionByName(new)
    keyed = materialize(keyed_events(ev, seq="arrival", chunk="split", keep=EVENT_COLS), "stream-events")
    found = materialize(aggregate_sessions(keyed, keep_key=True), "stream-sessions")

    newest = keyed.agg(F.max("_ts").alias("newest"))
    if clock is not None:
        newest = newest.union(clock.select("newest")).agg(F.max("newest").alias("newest"))
    newest = materialize(newest, "stream-clock")
    done = F.col("closed")
    if gap is not None:
        now = newest.select(F.col("newest") - F.expr(f"INTERVAL {gap}")).scalar()
        done = done | F.coalesce(F.col("session_end") < now, F.lit(False))
    marked = materialize(found.withColumn("_done", done), "stream-marked")

    left_open = marked.where(~F.col("_done")).select("_key", "seg")
    ended = marked.where("_done").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    counters = ended.select("_key", F.col("_n").alias("next_seg"))
    if next_seg is not None:
        counters = counters.union(next_seg.select("_key", "next_seg")).groupBy("_key").agg(F.sum("next_seg").alias("next_seg"))
    still = keyed.join(left_open, ["_key", "seg"], "left_semi").select(*EVENT_COLS)
    out = materialize(_with_base(marked.where("_done").drop("_done"), next_seg), "stream-out")
    state.save(2 * batch_id + 1, still, counters, newest)
    return out.drop("_key")


def flush_open(state: SessionState, batch_id: int, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """The sessions still open after batch ``batch_id`` (closed = false), written once and
    given to ``sink``; the next batch starts without them and goes on with their segment
    numbers. The state is saved after the sink, so a flush that fails is made again."""
    open_events, next_seg, clock = state.load(2 * batch_id + 1)
    keyed = keyed_events(open_events, seq="arrival", chunk="split", keep=EVENT_COLS)
    found = materialize(aggregate_sessions(keyed, keep_key=True), "stream-flush")
    out = materialize(_with_base(found, next_seg), "stream-out").drop("_key")
    if sink is not None:
        sink(out, 2 * batch_id + 2)
    ended = found.groupBy("_key").agg(F.count(F.lit(1)).alias("next_seg"))
    counters = ended.union(next_seg.select("_key", "next_seg")).groupBy("_key").agg(F.sum("next_seg").alias("next_seg"))
    state.save(2 * batch_id + 2, open_events.limit(0), counters, clock)
    return out


def stream_sessions(events: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], gap: str | None = None,
                    flush: bool = True) -> None:
    """Run the stream ``events`` over everything available; ``sink(sessions, batch)``
    gets the finished sessions of every micro-batch and, with ``flush``, those open at
    the end. ``batch`` counts 2n + 1 for micro-batch n and 2n + 2 for a flush after it;
    a retry repeats a number, so a sink that replaces its batch stays exact. What a run
    left open that ended before its flush is flushed by the next one, new events or not."""
    state = SessionState(events.sparkSession, f"{checkpoint}/sessions")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        sink(session_batch(batch, batch_id, state, gap), 2 * batch_id + 1)

    q = (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{checkpoint}/stream")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if flush and (batch_id := state.unflushed()) is not None:
        flush_open(state, batch_id, sink)


def dedupe_events(events: DataFrame, watermark: str = "10 minutes", keys=None) -> DataFrame:
    """T5: drop duplicate deliveries within the watermark. By default an event is a
    duplicate only if all its fields are equal; its place in the log doesn't count."""
    fields = list(keys) if keys else [c for c in events.columns if c not in ("split", "event_seq")]
    ts = parse_ts("timestamp")
    return (events.withColumn("_ets", ts).withWatermark("_ets", watermark)
            .dropDuplicatesWithinWatermark(fields).drop("_ets"))
