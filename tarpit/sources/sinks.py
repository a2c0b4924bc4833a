"""Session history, archive, metrics and model persistence.

The reference rewrites one CSV per batch. Here history is an append-only
Parquet table partitioned by ``batch_id``; a batch is written with dynamic
partition overwrite, so re-running a batch replaces it (idempotent) instead
of duplicating rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.common import with_scalars
from ..schemas import ENRICHED, METRICS, SESSIONS

def read_or_none(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``; None if it isn't there. Other failures are raised."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


METRIC_COLUMNS = {"accuracy": "ml_accuracy", "precision": "ml_precision", "recall": "ml_recall"}


def read_sessions(spark: SparkSession, path: str, fmt: str = "parquet", schema=ENRICHED) -> DataFrame:
    """Load stored sessions (Parquet table, or a CSV export with header)."""
    if fmt == "csv":
        return (spark.read.schema(schema).option("header", True).option("nanValue", "nan")
                .option("mode", "PERMISSIVE").csv(path))
    return spark.read.parquet(path)


def load_dashboard(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A dashboard dataset delivered as CSV with a header. With a
    schema the columns are typed on read; without, they stay text and the
    dashboard view coerces them (P22, P23, P29)."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r).csv(path)


def batches_together(df: DataFrame) -> DataFrame:
    """The rows of a batch in one task, those of a very large one in a few, so that a batch is
    one file and not one a task; in a file highest risk first (O1). The writer sorts by
    batch unless the rows already are, and would lose the order within."""
    risk = [F.col("risk_score").desc_nulls_last()] if "risk_score" in df.columns else []
    return df.hint("rebalance", "batch_id").sortWithinPartitions("batch_id", *risk)


def write_sessions(df: DataFrame, path: str, mode: str = "append", csv_path: str | None = None) -> None:
    """Write enriched sessions partitioned by batch; optional CSV export.

    Batches are replaced atomically per partition (dynamic overwrite), which
    makes retries of the same batch idempotent. Rows are written highest
    risk first (O1).
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    w = batches_together(df).write.partitionBy("batch_id")
    (w.mode("overwrite") if mode == "overwrite_batches" else w.mode(mode)).parquet(path)
    if csv_path:
        export_csv(df, csv_path)


def export_csv(df: DataFrame, path: str) -> None:
    """S6 CSV export with a header, timestamps as 'yyyy-MM-dd HH:mm:ss', highest risk first."""
    out = df.orderBy(F.col("risk_score").desc_nulls_last()) if "risk_score" in df.columns else df
    (out.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(path))


def archive_batch(new_rows: DataFrame, path: str) -> None:
    """The new rows of a batch to the archive, replacing that batch's partition
    (the reference re-appends the whole history every batch once it is large)."""
    new_rows.sparkSession.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    batches_together(new_rows).write.mode("overwrite").partitionBy("batch_id").parquet(path)


def merge_new_sessions(new: DataFrame, history: DataFrame, key: str = "session",
                       dedupe_within: bool = False, only_new: bool = False) -> DataFrame:
    """S8 + J3 + U1: drop sessions whose id is already stored, then append.

    Duplicates inside the new batch are kept unless ``dedupe_within``.
    ``only_new`` returns just the surviving new rows.
    """
    fresh = new.join(history.select(key).distinct(), key, "left_anti")
    if dedupe_within:
        fresh = fresh.dropDuplicates([key])
    if only_new:
        return fresh
    return history.unionByName(fresh, allowMissingColumns=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Persist the metrics record (one JSON row)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Load the metrics record."""
    return spark.read.schema(METRICS).json(path)


def metrics_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """A metrics dict (as returned by ml_risk) as a one-row DataFrame."""
    row = {f.name: metrics.get(f.name) for f in METRICS.fields}
    return spark.createDataFrame([row], METRICS)


def stamp_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Newest accuracy / precision / recall on every stored row (a
    scalar subquery over the one-row metrics record)."""
    m = metrics.select(*[F.col(k).cast("double").alias(v) for k, v in METRIC_COLUMNS.items()])
    return with_scalars(df.drop(*METRIC_COLUMNS.values()), m)


def publish(spark: SparkSession, history_path: str, metrics_path: str | None = None) -> DataFrame | None:
    """S15 + S10: the current snapshot for consumers, the stored history with the newest
    metrics on every row; None before the first batch."""
    history = read_or_none(spark, history_path)
    if history is None or metrics_path is None:
        return history
    metrics = read_or_none(spark, metrics_path, "json")
    return history if metrics is None else stamp_metrics(history, read_metrics(spark, metrics_path))


__all__ = ["read_sessions", "load_dashboard", "write_sessions", "archive_batch", "merge_new_sessions",
           "write_metrics", "read_metrics", "metrics_frame", "stamp_metrics", "publish", "read_or_none",
           "SESSIONS"]
