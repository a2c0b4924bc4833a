"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash of its id; a source's share of the mix is the
documents below a threshold on that hash, so no rows are sorted, a rerun picks
the same documents and a larger budget keeps all documents of a smaller one.
The threshold that meets a budget is found from sums: words by (source, hash
bucket), a running sum over at most 4,096 buckets of a source, then only the
bucket where the budget runs out is split into 4,096 finer ones, until it holds
one hash value. A budget above the source's size is two nested budgets: all its
documents once, and some a second time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.common import materialize, with_scalars
from .rows import WORD, free_name, hash60, hash60_sql

#: Weights of the sources in code-point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and most times a document is taken.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
HASH_BITS = 60
STEP_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size; one row a source) -> source, source_size, target.

    Water filling: a target is weight * level, at most ``max_epochs`` times the
    source's size. With sources in the order of the level at which they are full,
    the level is the first one at which the sources after it are not full yet.
    The windows run over one row a source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.lit(max_epochs) * F.col("source_size")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    full = sizes.withColumn("w", weight.cast("long")).withColumn("cap", cap.cast("long"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    steps = (full.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0)))
             .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
             .withColumn("goal", F.lit(float(total_share)) * F.sum("source_size").over(everything))
             .withColumn("level", (F.col("goal") - F.col("filled")) / F.col("rest"))
             .filter(F.col("level") <= F.col("cap") / F.col("w")))
    level = steps.agg(F.min_by("level", F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")).alias("level"))
    share = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")))
    return with_scalars(full, level).select("source", "source_size", share.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each (source, epoch, budget) the hash below which documents are taken.

    ``sized`` has (source, size, h). The sum of the sizes below the threshold is
    the largest that the budget covers, plus the documents of the next hash value
    if that comes nearer. All rows with one hash go together.
    """
    state = budgets.select("source", "epoch", F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("prefix"))
    done = None
    for bits_left in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        width = F.lit(bits_left).cast("int")
        rows = sized.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
                          & (F.shiftright("h", bits_left + STEP_BITS) == F.col("prefix")))
        sums = (rows.groupBy("source", "epoch", F.shiftright("h", bits_left).alias("bucket"))
                .agg(F.sum("size").alias("n"), F.min("h").alias("least"), F.max("h").alias("most"),
                     F.first("left").alias("left")))
        run = Window.partitionBy("source", "epoch").orderBy("bucket")
        edge = (sums.withColumn("upto", F.sum("n").over(run)).filter(F.col("upto") > F.col("left"))
                .groupBy("source", "epoch").agg(F.min(F.struct("bucket", "upto", "n", "least", "most", "left")).alias("b"))
                .select("source", "epoch", "b.*").withColumn("under", F.col("left") - (F.col("upto") - F.col("n"))))
        edge = materialize(edge, "edges")
        single = F.col("least") == F.col("most")
        over = F.col("upto") - F.col("left")
        ended = edge.filter(single).select("source", "epoch", F.when(over < F.col("under"), F.col("most") + 1)
                                           .otherwise(F.col("least")).alias("threshold"))
        done = ended if done is None else done.union(ended)
        state = edge.filter(~single).select("source", "epoch", F.col("under").alias("left"), F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    everything = F.lit(1 << HASH_BITS).cast("long")  # the budget covers the whole source
    found = done.withColumnsRenamed({"source": "s", "epoch": "e"})
    return budgets.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")), "left").select(
        "source", "epoch", F.coalesce("threshold", everything).alias("threshold"))


def plan(sized: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target and ``cuts``, the thresholds
    of its epochs; a document is taken once for each threshold above its hash."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = materialize(targets(sizes, weights, total_share, max_epochs), "targets")
    budgets = aims.select("source", "source_size", "target", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))).alias("epoch")).select(
        "source", "epoch", F.least(F.col("source_size").cast("double"), F.greatest(
            F.lit(0.0), F.col("target") - (F.col("epoch") - 1) * F.col("source_size"))).alias("budget"))
    cuts = thresholds(sized, budgets).groupBy(F.col("source").alias("s")).agg(F.sort_array(F.collect_list("threshold"), False).alias("cuts"))
    return materialize(aims.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and hash of every row; written once, as several passes read it."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")), "sizes")


def _copies(h: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda t: h < t)).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0. A null source is a source of its own, the
    last. Rows with one id (also null ids) are taken or left together. An empty
    table gives an empty one.
    """
    rows = sized(docs, id_col, text_col, source_col)
    how = plan(rows, **how).withColumnRenamed("source", "s")
    return (rows.join(how, F.col("source").eqNullSafe(F.col("s")))
            .withColumn("copies", _copies(F.col("h"), F.col("cuts")))
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns unchanged, each as often as it is taken.

    The plan is one row a source, written before: Spark broadcasts it if its size
    on disk is under its threshold and else joins with a skew-safe shuffle.
    """
    name, cuts, cut = (free_name(docs, x) for x in ("_mix_source", "_mix_cuts", "_mix_cut"))
    found = plan(sized(docs, id_col, text_col, source_col), **how).select(F.col("source").alias(name), F.col("cuts").alias(cuts))
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = docs.join(found, F.col(source_col).eqNullSafe(F.col(name)))
    return (taken.select(*own, F.explode(F.filter(cuts, lambda t: hash60(F.col(id_col)) < t)).alias(cut))
            .select(*own))


#: The mix in DuckDB, with the rule of ``thresholds`` written over all rows in hash order.
MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {hash60_sql('doc_id')} AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
      FROM d GROUP BY source),
f AS (SELECT *, coalesce(sum(cap) OVER o, 0)::BIGINT AS filled, ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER o, 0))::BIGINT AS rest
      FROM s WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM (
        SELECT source, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - filled) / rest AS level, cap::DOUBLE / w AS k FROM f)
      WHERE level <= k ORDER BY k, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(w * (SELECT level FROM l), cap::DOUBLE) AS target FROM s),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
c AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto FROM g),
e AS (SELECT c.source, c.h, t.source_size, t.target,
        (SELECT count(*) FROM (VALUES (1), (2)) v(k)
         WHERE upto <= least(source_size::DOUBLE, greatest(0, target - (k - 1) * source_size))
            OR (upto - n < least(source_size::DOUBLE, greatest(0, target - (k - 1) * source_size))
                AND upto - least(source_size::DOUBLE, greatest(0, target - (k - 1) * source_size))
                  < least(source_size::DOUBLE, greatest(0, target - (k - 1) * source_size)) - (upto - n))) AS copies
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT d.doc_id, d.size, e.source_size, e.target, (d.size * e.copies)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""
