"""Order statistics without a sort: histograms that are refined where a rank lies.

The range of the values is cut into equal buckets, counted in one aggregate; only the
bucket that holds the rank is read again, between its own least and greatest value,
until it has one value or few rows. Nothing is sorted or moved but a histogram of
``BUCKETS`` rows a round, and at the end one bucket of ``FEW`` rows at most.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 12
FEW = 1 << 14


def order_statistics(df: DataFrame, col: str, ranks: list[int], weight: str | None = None) -> list[float]:
    """The values at 0-based ``ranks`` (below the number of values) among the non-null, finite
    values of ``col`` in ascending order; a row counts ``weight`` times (by default once)."""
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    values = df.select(F.col(col).cast("double").alias("v"), times.alias("w")).where(F.col("v").isNotNull() & (F.col("w") > 0))
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    if not all(0 <= rank < (span["n"] or 0) for rank in ranks):
        raise ValueError(f"ranks {ranks} of {span['n'] or 0} values")
    if ranks and not (math.isfinite(span["lo"]) and math.isfinite(span["hi"])):
        raise ValueError("order statistics need finite values")
    found: dict[int, float] = {}
    _within(values, span, 0, sorted(set(ranks)), found)
    return [found[r] for r in ranks]


def _within(part: DataFrame, span, before: int, ranks: list[int], found: dict[int, float]) -> None:
    """The values at the ranks, all between the bounds of ``span``, ``before`` values being less."""
    lo, hi = span["lo"], span["hi"]
    if not ranks or lo == hi:
        found.update(dict.fromkeys(ranks, lo))
        return
    if span["rows"] <= FEW:
        own = sorted(part.groupBy("v").agg(F.sum("w").alias("w")).collect())
        ends = list(accumulate(r["w"] for r in own))
        found.update({rank: own[bisect_right(ends, rank - before)]["v"] for rank in ranks})
        return
    # halves, so that the width of the whole range of doubles is finite
    share = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    counts = part.groupBy(bucket.alias("b")).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    for row in sorted(counts.collect(), key=lambda r: r["b"]):  # BUCKETS rows at most
        own = [r for r in ranks if before <= r < before + row["n"]]
        if own:
            _within(part.where(F.col("v").between(row["lo"], row["hi"])), row, before, own, found)
        before += row["n"]


def quantile(df: DataFrame, col: str, q: float, weight: str | None = None) -> float | None:
    """Exact linear-interpolated quantile of the non-null values; None without any."""
    n = df.agg(F.sum(F.when(F.col(col).isNotNull(), F.lit(1) if weight is None else F.col(weight))).alias("n")).first()["n"]
    if not n:
        return None
    at = q * (n - 1)
    low, high = order_statistics(df, col, [math.floor(at), math.ceil(at)], weight)
    return low + (high - low) * (at - math.floor(at))
