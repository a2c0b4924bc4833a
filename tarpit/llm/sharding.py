"""Sharding by extendible hashing.

A shard is a prefix of the bits of a document's hash. The directory starts with one
bucket; a bucket over the byte limit splits on its next bit, all others stay, until
every shard fits. What splits is decided from sums, not from rows: bytes by the
first ``STEP`` more bits than the data needs, summed up for every shorter prefix,
give the shallowest prefix that fits for all buckets at once; only the rows of
buckets that are still too large are looked at again, by ``STEP`` more bits.

A bucket whose rows have one hash (a document over the limit, or equal ids) cannot
split and is a shard of its own, marked ``oversized``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.common import materialize
from .rows import free_name, hash60, hash60_sql

HASH_BITS = 60
STEP = 4
#: Bytes of text of a shard, at most. A parameter; this default suits shards that
#: are the unit of shuffling in training.
SHARD_BYTES = 1 << 20


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> list[tuple[int, DataFrame]]:
    """``rows`` (h, bytes) -> a table (bucket, depth) for one or more resolutions: the
    first that has a row for a hash's bucket says how many of its bits name its shard.

    A table has a row for each non-empty bucket, some ``2 ** STEP`` times as many as
    shards; later ones only for the buckets of the one before that had to go on."""
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    bits = min(HASH_BITS, STEP + max(0, math.ceil(math.log2(max(1, total) / limit))))
    found, left = [], rows
    least = 0
    while True:
        fine = materialize(left.groupBy(_prefix(F.col("h"), bits).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")), "buckets")
        depths = fine.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(bits)))).withColumn(
            "prefix", F.call_function("shiftright", "bucket", (F.lit(bits) - F.col("depth")).cast("int")))
        fits = depths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("sum"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(
            (F.col("sum") <= limit) | (F.col("lo") == F.col("hi")))
        leaf = depths.join(fits.select("depth", "prefix"), ["depth", "prefix"]).groupBy("bucket").agg(F.min("depth").alias("depth"))
        leaf = materialize(leaf, "directory")
        found.append((bits, leaf))
        over = fine.join(leaf, "bucket", "left_anti").select(F.col("bucket").alias("b"))
        if bits == HASH_BITS or over.isEmpty():
            return found
        left = left.join(over, _prefix(F.col("h"), bits) == F.col("b"), "left_semi")
        least, bits = bits + 1, min(HASH_BITS, bits + STEP)


def with_shard(rows: DataFrame, tables: list[tuple[int, DataFrame]], h: Column, name: str = "shard") -> DataFrame:
    """``rows`` with the bits that name their shard, as text ('' if there is one shard)."""
    depth = []
    for k, (bits, table) in enumerate(tables):
        bucket = free_name(rows, f"_bucket{k}")
        depth.append(free_name(rows, f"_depth{k}"))
        rows = rows.join(table.withColumnsRenamed({"bucket": bucket, "depth": depth[-1]}),
                         _prefix(h, bits) == F.col(bucket), "left").drop(bucket)
    own = F.coalesce(*depth)
    bits = F.when(own == 0, F.lit("")).otherwise(F.lpad(F.bin(_prefix(h, own)), own, "0"))
    return rows.withColumn(name, bits).drop(*depth)


def shard_report(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, size (bytes of text), shard, depth, shard_bytes, oversized.

    Null texts have 0 bytes, null ids share one hash, rows with equal ids a shard."""
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("size"),
                                   hash60(F.col(id_col)).alias("h")), "sizes")
    tables = directory(rows.select("h", F.col("size").alias("bytes")), limit)
    named = materialize(with_shard(rows, tables, F.col("h")), "sharded")
    # a shard is hot only if it cannot split (equal or null ids): AQE splits its rows in the join
    sums = named.groupBy("shard").agg(F.sum("size").alias("shard_bytes"))
    return named.join(sums, "shard").select("doc_id", "size", "shard", F.length("shard").alias("depth"), "shard_bytes",
                                            (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs``, all columns, as Parquet in one folder a shard (``_shard=b<bits>``,
    ``_shard=all`` if there is one; the name gets underscores while ``docs`` has a column
    called so). A task writes whole shards, which fit the limit."""
    rows = docs.select(hash60(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("bytes"))
    tables = directory(materialize(rows, "sizes"), limit)
    name = free_name(docs, "_shard")
    named = with_shard(docs, tables, hash60(F.col(id_col)), name)
    out = named.withColumn(name, F.when(F.col(name) == "", F.lit("all")).otherwise(F.concat(F.lit("b"), name)))
    out.repartition(name).write.partitionBy(name).parquet(path)


#: The sharding in DuckDB: the shallowest prefix that fits, of all prefixes.
SHARD_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size, {hash60_sql('doc_id')} AS h FROM documents),
p AS (SELECT k, h >> (60 - k) AS b, sum(size) AS n, count(DISTINCT h) AS hashes FROM d, (SELECT unnest(range(0, 61)) AS k) GROUP BY ALL),
l AS (SELECT h, min(k) AS depth FROM (SELECT DISTINCT h FROM d) JOIN p ON b = h >> (60 - k)
      WHERE n <= 1048576 OR hashes = 1 GROUP BY h),
s AS (SELECT doc_id, size, depth, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth::INTEGER, '0') END AS shard
      FROM d JOIN l USING (h))
SELECT doc_id, size, shard, depth::INTEGER AS depth, (sum(size) OVER (PARTITION BY shard))::BIGINT AS shard_bytes,
       sum(size) OVER (PARTITION BY shard) > 1048576 AS oversized
FROM s
"""
