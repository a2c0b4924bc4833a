"""Small shared DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame (global statistics, a
    metrics record) to every row as a scalar subquery: computed once, no
    join, and an error if it ever returns more than one row."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_scalars")).scalar()
    out = df.withColumn("_scalars", packed)
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.col("_scalars").getField(c).alias(c) for c in cols])


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage before multi-consumer / multi-pass stages.

    The rows are written once as a Parquet table below the shared folder
    named by ``spark.checkpoint.dir`` (survives executor loss; never a local
    checkpoint or a machine-local folder) and read back, so later stages
    start from a short plan with real size statistics.
    """
    import uuid

    from ..session import shared_path
    path = shared_path(df.sparkSession, f"tables/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder that no later step reads; nothing if it isn't there."""
    store, at = _hadoop(spark, path)
    store.delete(at, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    store, at = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(at)) if store.exists(at) else []
