"""Which range covers an address, by cutting and sweeping (J4 for large range tables).

Ranges may nest and overlap; of those that cover an address the one that starts last
wins, of these the shortest: the longest prefix where ranges are networks. The address
space is cut into parts that hold about equally many range ends and addresses. In each
part the ranges are cut once into disjoint intervals, then addresses and intervals are
read side by side in order. No range is spread over prefixes, so a dense or deeply
nested part of the space is no hot cell.

A range that reaches beyond its part is carried on only to parts where no range of its
own part that starts later covers it. For one part these stretches are disjoint, and
each begins at a cut or behind another range's end, so a part receives no more rows than
it has range ends, and one from each part before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import ip as I
from .common import materialize


def _part(x: Column | str, cuts: list[int]) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(x))) if cuts else F.lit(0)


def cut_points(positions: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` values that cut ``col`` into parts of about equal rows."""
    shares = [k / parts for k in range(1, parts)]
    found = positions.agg(F.percentile_approx(col, shares, 20 * parts).alias("cuts")).first()["cuts"] if shares else None
    return sorted(set(found or []))


def _sweep(rows: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int, int, int]]:
    """Disjoint (start, stop, ip_start, ip_end) within lo..hi; ``rows`` (ip_start, ip_end)
    by start, longest first. The last of ``open_`` that hasn't ended wins."""
    open_, out, at = [], [], lo
    for row in [*rows, (hi + 1, hi + 1)]:
        while at < row[0]:
            while open_ and open_[-1][1] < at:
                open_.pop()
            if not open_:
                break
            out.append((at, min(open_[-1][1], row[0] - 1), *open_[-1]))
            at = out[-1][1] + 1
        at = max(at, row[0])
        open_.append(row)
    return out


def disjoint_intervals(keys: DataFrame, cuts: list[int]) -> DataFrame:
    """``keys`` (ip_start, ip_end; distinct) -> part, start, stop, ip_start, ip_end: disjoint
    intervals, none across a cut, with the range that wins there."""
    own = keys.select(_part("ip_start", cuts).alias("part"), "ip_start", "ip_end")
    later = Window.partitionBy("part").orderBy(F.desc("ip_start"), "ip_end").rowsBetween(Window.unboundedPreceding, -1)
    rows = own
    if cuts:
        beyond = (own.withColumn("hidden", F.max("ip_end").over(later)).withColumn("cut", F.get(F.lit(cuts), F.col("part")))
                  .where((F.col("ip_end") >= F.col("cut")) & (F.col("hidden").isNull() | (F.col("ip_end") > F.col("hidden"))))
                  .withColumn("seen", F.greatest("cut", F.col("hidden") + 1)))
        rows = own.unionByName(beyond.select(F.explode(F.sequence(_part("seen", cuts), _part("ip_end", cuts))).alias("part"),
                                             "ip_start", "ip_end"))

    def cut(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        group = group.sort_by([("ip_start", "ascending"), ("ip_end", "descending")])
        starts, ends = group.column("ip_start").to_pylist(), group.column("ip_end").to_pylist()
        lo = cuts[k - 1] if k else starts[0]
        hi = cuts[k] - 1 if k < len(cuts) else max(ends)
        found = _sweep(list(zip(starts, ends)), lo, hi)
        columns = list(zip(*found)) or [[]] * 4
        return pa.table([pa.array([k] * len(found), pa.int32()), *[pa.array(c, pa.int64()) for c in columns]],
                        names=["part", "start", "stop", "ip_start", "ip_end"])

    return rows.groupBy("part").applyInArrow(cut, "part int, start long, stop long, ip_start long, ip_end long")


def lookup_by_sweep(ips: DataFrame, ranges: DataFrame, ip_col: str = "ip", parts: int | None = None) -> DataFrame:
    """Distinct IP texts -> ``ip_col`` and the attributes of the covering range that wins;
    IPs that no range covers, and texts that are no address, are absent.

    Of ranges with the same ends the one with the least attributes wins; ranges without
    a start or end, or that end before they start, cover nothing.
    """
    parts = parts or int(ips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    attrs = [c for c in ranges.columns if c not in ("ip_start", "ip_end")]
    best = materialize(ranges.where(F.col("ip_start") <= F.col("ip_end")).groupBy("ip_start", "ip_end").agg(
        F.min(F.struct(*[F.col(f"`{a}`") for a in attrs])).alias("attrs")), "ranges")
    keys = best.select("ip_start", "ip_end")
    asked = materialize(ips.select(F.col(ip_col).alias("ip"), I.ipv4_to_long(ip_col).alias("at")).where("at is not null").distinct(), "ips")
    ends = keys.select(F.explode(F.array("ip_start", F.col("ip_end") + 1)).alias("at"))
    cuts = cut_points(asked.select("at").union(ends), "at", parts)

    segments = disjoint_intervals(keys, cuts).select(
        "part", F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("ip"),
        F.struct("stop", "ip_start", "ip_end").alias("segment"))
    points = asked.select(_part("at", cuts).alias("part"), "at", F.lit(1).alias("kind"), "ip",
                          F.lit(None).cast(segments.schema["segment"].dataType).alias("segment"))
    before = Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = (segments.unionByName(points).withColumn("segment", F.last("segment", ignorenulls=True).over(before))
            .where((F.col("kind") == 1) & (F.col("at") <= F.col("segment.stop"))).select("ip", "segment.ip_start", "segment.ip_end"))
    return hits.join(best, ["ip_start", "ip_end"]).select(F.col("ip").alias(ip_col), *[F.col("attrs").getField(a).alias(a) for a in attrs])
