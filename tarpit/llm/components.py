"""Connected components of a link table, as Spark joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every step only needs, per node, the
smallest neighbour, which is an aggregate with map-side combine; no group is
collected, so a node with very many links costs no more than its share of rows.
Each round is written to the shared folder, so a lost executor re-runs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """(a, m): the smaller of node a and its smallest neighbour b."""
    return pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _open(edges: DataFrame) -> bool:
    """Whether some node still has two targets or a target with a target of its own."""
    several = edges.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x")
    chained = edges.select(F.col("y").alias("x")).distinct().join(edges.select("x").distinct(), "x", "left_semi")
    return not several.union(chained).isEmpty()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable.

    Direction, repeats and self links don't matter; rows with a null are left
    out. Only nodes that have a link to another node are returned. An empty
    table gives an empty table. Raises if ``max_rounds`` do not suffice (the
    number of rounds grows with the logarithm of the longest path).
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
                        .distinct(), "links")
    for _ in range(max_rounds):
        if not _open(edges):
            star = edges.select(F.col("x").alias("node"), F.col("y").alias("component"))
            return star.union(edges.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
        # large star: the neighbours above a node go to the least of its neighbourhood
        up, down = (edges.select(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("y", "x"), ("x", "y")))
        large = (up.join(_least(up.union(down)), "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
                 .filter("x > y").distinct())
        # small star: a node and its neighbours below it go to the least of these
        down = large.select(F.col("x").alias("a"), F.col("y").alias("b"))
        least = _least(down)
        small = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(
            least.select(F.col("a").alias("x"), F.col("m").alias("y")))
        edges = materialize(small.filter("x > y").distinct(), "links")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
