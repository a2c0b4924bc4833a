"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2048, megabytes: int = 16) -> None:
    """Bound the Arrow batches sent to Python by rows and by bytes, so a run of
    very long texts cannot fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df`` (no shuffle)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added while a column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns, to tell repeated ids with different rows apart."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def hash60(col: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text (null: of the empty text)
    as a non-negative long. MD5 so that any SQL engine can name the same rows."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


#: ``hash60`` in DuckDB.
def hash60_sql(expr: str) -> str:
    return f"('0x' || substr(md5(coalesce(({expr})::VARCHAR, '')), 1, 15))::BIGINT"


#: DuckDB table ``crc(t)`` of one row that ``crc32_sql`` needs beside it: the CRC of each byte, by its rule.
CRC_TABLE_SQL = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32_sql(expr: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes in DuckDB, which has no function for it."""
    return (f"xor(4294967295, list_reduce(list_transform(range(1, 2 * octet_length(encode({expr})), 2), "
            f"lambda i: ('0x' || substr(hex(encode({expr})), i, 2))::BIGINT), "
            "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]), 4294967295))")
