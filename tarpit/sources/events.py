"""Event-log readers (S1 batch, S2-S4 stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import RAW_EVENT

_CORRUPT = "_corrupt_record"
_PARSE_SCHEMA = T.StructType(RAW_EVENT.fields + [T.StructField(_CORRUPT, T.StringType())])


def parse_event_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """NDJSON text lines -> raw events; blank and malformed lines are dropped.

    Lines are stripped first; a line that is not a JSON object yields a
    non-NULL corrupt-record column and is skipped silently, like the
    reference's reader. List-valued fields keep their JSON text.
    """
    stripped = F.trim(F.col(value_col))
    parsed = F.from_json(stripped, _PARSE_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    cols = [c for c in lines.columns if c != value_col]
    out = (lines.where(stripped != "")
           .select(*cols, parsed.alias("_e"))
           .where(F.col("_e").isNotNull() & F.col(f"_e.{_CORRUPT}").isNull()))
    return out.select(*cols, *[F.col(f"_e.{f.name}").alias(f.name) for f in RAW_EVENT.fields])


def _with_split(lines: DataFrame) -> DataFrame:
    """Text lines with ``split``, the input split they are of: a struct (file time,
    file, block) that sorts as the log was written. Spark packs small files into
    partitions by size, so a row id alone does not follow a rotated log; within one
    split it does."""
    return lines.select("value", F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block")).alias("split"))


def with_arrival(events: DataFrame) -> DataFrame:
    """Events read by this module, and not shuffled since, with ``arrival``: their place
    in the log, split and row, as a struct that sorts in arrival order."""
    return events.withColumn("arrival", F.struct("split", F.monotonically_increasing_id().alias("row")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scan NDJSON event logs (file or folder) into raw events.

    ``arrival`` orders events by file modification time, then path, then line;
    ``split`` is the input split, a bounded run of that order. The log is read
    once and nothing is numbered; ``sessionize(seq="arrival", chunk="split")``
    takes both as they are.
    """
    return with_arrival(parse_event_lines(_with_split(spark.read.text(path))))


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                  max_bytes_per_trigger: str | None = None) -> DataFrame:
    """A growing log folder as a stream of raw events with ``split``; a
    micro-batch gets its ``arrival`` from ``with_arrival``.

    Rotated/replaced logs land as new files (the file source tracks files,
    not byte offsets); triggers can be bounded by file count or bytes.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return parse_event_lines(_with_split(reader.load(path)))
