"""Incremental runs over a growing log folder.

The reference keeps a byte offset and a state file and re-runs every ten
minutes. Here the log folder is a file stream; ``trigger(availableNow=True)``
processes whatever arrived since the last run and stops, and the checkpoint
(offset + commit log) replaces the state file: a failed batch is retried by
the next run instead of being skipped. Every micro-batch is enriched and
written to the history as its own batch partition, so a retry replaces it.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.common import materialize
from ..operators.ids import SESSION_COUNTER_START
from ..plans.enrich import enrich
from ..sources import sinks as S
from ..sources.events import stream_events
from .sessionizer import stream_sessions


def write_ndjson(events: DataFrame, path: str, files: int = 8, rows_per_file: int = 1 << 20) -> None:
    """Land raw events as NDJSON log files in arrival order, like a rotating log:
    equal ranges of ``event_seq``, at least ``files`` and about ``rows_per_file`` rows
    each, written one after another so that modification times follow the log."""
    cols = ["session", "src_ip", "eventid", "timestamp", "input", "username"]
    lines = events.select("event_seq", F.to_json(F.struct(*cols)).alias("value"))
    span = events.agg(F.min("event_seq").alias("lo"), F.max("event_seq").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    files = max(files, -(-span["n"] // rows_per_file))
    width = ((span["hi"] or 0) - (span["lo"] or 0)) // files + 1
    for i in range(files):
        lo = (span["lo"] or 0) + i * width
        part = lines.where((F.col("event_seq") >= lo) & (F.col("event_seq") < lo + width))
        part.coalesce(1).sortWithinPartitions("event_seq").select("value").write.mode("append" if i else "overwrite").text(path)


def write_growing_log(events: DataFrame, path: str, phase: int, phases: int = 3, files: int = 8, rows_per_file: int = 1 << 18) -> None:
    """The raw events as logs that grow: equal ranges of ``event_seq`` arrive in ``phases``
    steps, each dealt to the files in order. A call makes one step: in step 0 the files
    begin, in each other step but the last they get lines appended; in the last they are
    rotated to another name and begin anew.

    A file is written whole and put in place of the shorter one, so a task that runs
    again does no harm; a task holds one file."""
    cols = ["session", "src_ip", "eventid", "timestamp", "input", "username"]
    span = events.agg(F.min("event_seq").alias("lo"), F.max("event_seq").alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // phases + 1
    files = max(files, -(-width // rows_per_file))
    per_file = -(-width // files)
    at = F.col("event_seq") - lo
    lines = events.select(F.floor(at / width).alias("phase"), F.floor((at % width) / per_file).alias("file"), "event_seq",
                          F.to_json(F.struct(*cols)).alias("value"))
    fresh = 0 < phase == phases - 1
    lines = lines.where(F.col("phase") == phase if fresh else F.col("phase") <= phase)

    def land(key: tuple, rows: pa.Table) -> pa.Table:
        store, base = (fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path))
        name = f"log-{key[0].as_py():06d}.json"
        store.create_dir(base)
        if fresh:  # the log of before goes on under a name that sorts before
            old = f"{base}/{name}"
            if store.get_file_info(f"{base}/done-{name}").type == fs.FileType.NotFound and store.get_file_info(old).type == fs.FileType.File:
                store.move(old, f"{base}/done-{name}")
        with store.open_output_stream(f"{base}/_{name}") as out:
            for line in rows.sort_by([("phase", "ascending"), ("event_seq", "ascending")]).column("value").to_pylist():
                out.write(line.encode() + b"\n")
        store.move(f"{base}/_{name}", f"{base}/{name}")
        return pa.table({"file": pa.array([key[0].as_py()], pa.int64())})

    lines.groupBy("file").applyInArrow(land, "file long").count()


def stream_to_table(sdf: DataFrame, out_path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a streaming query over everything available (availableNow) into a
    Parquet table. ``append`` adds finished rows; ``complete`` rewrites the
    (small, bounded) result table each trigger, e.g. per-day counters."""
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out_path).start()
    else:
        q = w.foreachBatch(lambda b, _id: b.write.mode("overwrite").parquet(out_path)).start()
    q.awaitTermination()


def run_incremental(spark: SparkSession, log_dir: str, history_path: str, checkpoint: str,
                    ranges: DataFrame, gap: str | None = None, flush: bool = True,
                    max_files_per_trigger: int | None = None, enrich_kwargs: dict | None = None,
                    archive_path: str | None = None, metrics_path: str | None = None) -> DataFrame | None:
    """Log folder -> sessions -> per-batch enrich -> history; returns the snapshot.

    Each batch: enrich the finished sessions with the stored history as the base of
    the cumulative evaluation (M13), drop records already stored (S8, by session
    and segment, other batches only), number them on from the stored ids (P20),
    write the batch partition (S6), its archive (S7) and the metrics record (S9),
    and stamp the newest metrics on all rows of the snapshot (S10). With no new
    rows the last snapshot is returned again.
    """
    enrich_kwargs = dict(enrich_kwargs or {})
    events = stream_events(spark, log_dir, max_files_per_trigger=max_files_per_trigger)

    def stored(batch: int) -> DataFrame | None:
        h = S.read_or_none(spark, history_path)
        return None if h is None else h.where(F.col("batch_id") != batch)

    def per_batch(sessions: DataFrame, batch: int) -> None:
        before = stored(batch)
        if before is not None:
            known = before.select("session", "seg").distinct()
            sessions = materialize(sessions.join(known, ["session", "seg"], "left_anti"), "stream-new")
        if sessions.isEmpty():
            return
        n = 0 if before is None else before.count()
        info: dict = {}
        rows = enrich(sessions, ranges, history=before, info=info, id_start=SESSION_COUNTER_START + n, **enrich_kwargs)
        rows = rows.withColumn("batch_id", F.lit(batch).cast("bigint"))
        S.write_sessions(rows, history_path, mode="overwrite_batches")
        if archive_path:
            S.archive_batch(rows, archive_path)
        if metrics_path and info.get("metrics"):
            S.write_metrics(S.metrics_frame(spark, info["metrics"]), metrics_path)

    stream_sessions(events, checkpoint, per_batch, gap=gap, flush=flush)
    return S.publish(spark, history_path, metrics_path)
