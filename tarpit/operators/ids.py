"""Distributed sequence numbering (W3 / P20) and batch ids.

A global ``row_number() OVER (ORDER BY ...)`` moves every row into one task.
Here rows are range-partitioned on the (unique) order key, numbered inside
each partition, and shifted by the row count of all earlier partitions. The
offset table has one row per partition, so broadcasting it is bounded by the
partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import session_id_text

# Fixed values of the reference: first session number and rows per batch.
SESSION_COUNTER_START = 9786
BATCH_SIZE = 9865


def range_frozen(df: DataFrame, order: list[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order``, sort inside partitions and record each
    row's partition (``_pid``) and position (``_mid``) -- written once.

    Spark's range partitioner samples its input with a seed derived from the
    RDD id, so two evaluations of the same plan may cut different ranges;
    counting rows per partition in one evaluation and numbering them in
    another would then disagree. Freezing the assignment (a written table in
    the shared folder) makes every later use consistent and survives
    executor loss.
    """
    from .common import materialize
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    return materialize(ranged, "ranged")


def with_sequence_number(df: DataFrame, order: list[str | Column], out: str = "row_idx",
                         start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based (plus ``start``) position in ``order``.

    ``order`` must be a total order (end it with a unique key) so the result
    is deterministic and survives task retries.
    """
    ranged = range_frozen(df, order, num_partitions)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (ranged.join(F.broadcast(offs), "_pid")
            .withColumn(out, (F.lit(start) + F.col("_off") + local).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def with_batch_ids(df: DataFrame, order: list[str | Column], batch_size: int = BATCH_SIZE,
                   id_start: int = SESSION_COUNTER_START,
                   order_cols=("session", "seg", "closed", "first_seq", "last_seq")) -> DataFrame:
    """S4 + P20: ``batch_id`` = position div batch_size; ``session_id`` = SESS-%05d.

    Only ``order_cols``, the columns that ``order`` uses, are sorted and written; the
    first two name a row, and the number is joined back by them."""
    key = list(order_cols[:2])
    numbers = with_sequence_number(df.select(*order_cols), order, out="_idx").select(*key, "_idx")
    return (df.join(numbers, key)
            .withColumn("batch_id", F.floor(F.col("_idx") / F.lit(batch_size)).cast("bigint"))
            .withColumn("session_id", session_id_text(F.col("_idx") + F.lit(id_start)))
            .drop("_idx"))
