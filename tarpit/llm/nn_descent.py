"""Embedding near-duplicates by NN-descent.

1. Equal vectors become one node. Each node gets a first neighbour list from a few
   tables of random hyperplanes (signs around the mean name a bucket; inside a
   bucket all cosines are taken). Larger inputs have more bits, and as many more
   tables as a pair at the threshold then needs to meet.
2. A round of NN-descent lets the neighbours of every node, in both directions, meet
   each other: neighbours of neighbours replace worse entries of the lists. New
   tables of hyperplanes a round bring in strangers.
3. An audit takes a bounded number of queries a round against all nodes, in blocks,
   and compares the links found: recall per asked node, averaged over those of about
   as many links, so a large group doesn't hide missed pairs. Rounds go on (``rounds``
   at most) while a class of them is under ``GOOD_RECALL``, fewer than ``LINKED`` asked
   nodes have links or a round merges components; a recall under ``MIN_RECALL`` at the
   end is an error.
4. A list whose entries are all links is saturated and may hide more. Links
   therefore aren't read off the lists: every cell also reports a spanning forest of
   its links, components are built from these, and the list of every linked node
   is enlarged to its whole component, compared in blocks of ``BLOCK`` nodes.

Cells (buckets, neighbourhoods) that would be larger than ``CELL`` nodes are dealt at
random into several, by a hash that changes with the round, so no group lands in one
task; a component of m nodes makes (m / BLOCK)^2 / 2 cells of bounded size. Counting
links exactly is quadratic inside a component, as the number of links itself is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.common import materialize
from .components import components
from .rows import bounded_batches

THRESHOLD = 0.9
K = 10
TABLES = 6
BUCKET = 128
CELL = 256
BLOCK = 256
ROUNDS = 6
AUDIT_QUERIES = 1_024
LINKED = 100
GOOD_RECALL = 0.995
MIN_RECALL = 0.9


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of length 1 in double precision."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_run(fn: Callable[[pa.Table], dict | None], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that calls ``fn`` on each run of equal first columns (rows
    come sorted by it) and emits its columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])).tolist()
            out = [x for a, b in zip(cuts[:-1], cuts[1:]) if (x := fn(table.slice(a, b - a))) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[f.name] for x in out]), f.type) for f in schema], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            if last:
                yield from emit(table.slice(0, last).combine_chunks())
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from emit(held.combine_chunks())

    return run


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    free, edges = linked.any(axis=1), []
    for root in np.flatnonzero(free).tolist():
        if not free[root]:
            continue
        free[root], front = False, [root]
        while front:
            x = front.pop()
            new = np.flatnonzero(linked[x] & free)
            free[new] = False
            edges += [(x, int(y)) for y in new]
            front += new.tolist()
    return edges


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])


def _meet(cells: DataFrame, k: int, threshold: float) -> DataFrame:
    """``cells`` (cell, node, bar, e) -> (a, b, sim): for every node its best ``k``
    partners in the cell that beat its ``bar``, and a spanning forest of the links."""
    def meet(t: pa.Table) -> dict | None:
        n = t.num_rows
        if n < 2:
            return None
        node, bar = t.column("node").to_numpy(), t.column("bar").to_numpy()
        x = unit_rows(t.column("e").combine_chunks())
        s = x @ x.T
        s[node[:, None] == node[None, :]] = -2
        best = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (n, 1))
        sim = np.take_along_axis(s, best, axis=1)
        row, col = np.nonzero(sim > np.maximum(bar, -1.5)[:, None])
        a, b, c = [node[row]], [node[best[row, col]]], [sim[row, col]]
        linked = s >= threshold
        if linked.any():
            i, j = map(np.array, zip(*forest(linked)))
            a, b, c = [*a, node[i]], [*b, node[j]], [*c, s[i, j]]
        return {"a": np.concatenate(a), "b": np.concatenate(b), "sim": np.concatenate(c)}

    parted = cells.select("cell", "node", "bar", "e").repartition("cell").sortWithinPartitions("cell")
    return parted.mapInArrow(by_run(meet, PAIRS), "a long, b long, sim double")


def _dealt(rows: DataFrame, key: list[str], most: int, seed: int) -> DataFrame:
    """``rows`` with ``cell``: a hash of the key, and for keys with more than ``most``
    rows of one of several parts chosen by the node's hash."""
    large = rows.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(
        *[F.col(c).alias(f"_{c}") for c in key], F.ceil(F.col("_n") / most).alias("_parts"))
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("node", F.lit(seed)), F.col("_parts"))).otherwise(0)
    return rows.join(large, same, "left").withColumn("cell", F.xxhash64(*key, part)).drop("_parts", *[f"_{c}" for c in key])


def _table_cells(nodes: DataFrame, bars: DataFrame | None, tables: int, bits: int, mean: dict[int, np.ndarray], seed: int) -> DataFrame:
    """Every node in its bucket of each of ``tables`` random hyperplane tables."""
    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.filter(pa.array(dims == dim))
                x = unit_rows(own.column(1)) - mean[dim]
                for t in range(tables):
                    planes = np.random.default_rng([seed, t, dim]).standard_normal((dim, bits))
                    code = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.full(len(x), seed * 1000 + t, dtype=np.int32)),
                                                      pa.array(np.full(len(x), dim, dtype=np.int32)), pa.array(code)],
                                                     names=["node", "t", "dim", "code"])

    keyed = nodes.select("node", "e", "dim").mapInArrow(signs, "node long, t int, dim int, code long")
    cells = _dealt(keyed, ["t", "dim", "code"], CELL, seed).select("cell", "node")
    return _with_vectors(cells, nodes, bars)


def _with_vectors(cells: DataFrame, nodes: DataFrame, bars: DataFrame | None) -> DataFrame:
    if bars is None:
        known = nodes.select("node", "e", F.lit(-2.0).alias("bar"))
    else:
        known = nodes.select("node", "e").join(bars, "node", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
    return cells.join(known, "node")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """(node, near): the best k partners of each node; both directions count."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "sim").union(
        pairs.filter("a <> b").select("b", "a", "sim"))
    one = both.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    rank = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    return one.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k).select("node", "other", "sim")


def _bars(lists: DataFrame, k: int) -> DataFrame:
    """What a new neighbour must beat: the last entry of a full list."""
    return lists.groupBy("node").agg(F.min("sim").alias("bar"), F.count("*").alias("n")).select(
        "node", F.when(F.col("n") >= k, F.col("bar")).otherwise(-2.0).alias("bar"))


def _true_links(nodes: DataFrame, step: int, threshold: float) -> DataFrame:
    """All links (a, b) of the ``AUDIT_QUERIES`` nodes b that are asked in a round: those
    of least hash that weren't asked before."""
    asked = nodes.select("node", "e", "dim").orderBy(F.xxhash64("node", F.lit(99)), "node").offset((step - 1) * AUDIT_QUERIES).limit(AUDIT_QUERIES).toArrow()
    dims = asked.column("dim").to_numpy()
    queries = {d: (asked.column("node").to_numpy()[dims == d], unit_rows(asked.filter(pa.array(dims == d)).column("e").combine_chunks()))
               for d in np.unique(dims).tolist()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, (names, q) in queries.items():
                own = b.filter(pa.array(b.column(2).to_numpy() == d))
                if own.num_rows:
                    s = unit_rows(own.column(1)) @ q.T
                    i, j = np.nonzero(s >= threshold)
                    a, c = own.column(0).to_numpy()[i], names[j]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c])], names=["a", "b"])

    return materialize(nodes.select("node", "e", "dim").mapInArrow(scan, "a long, b long"), "true")


def _audit(true: DataFrame, part: DataFrame) -> list[tuple[int, float]]:
    """(nodes, recall) by the power of two of a node's links: the asked nodes that have
    links, and the mean share of a node's true links whose ends are in one component."""
    ends = true.join(part.withColumnsRenamed({"node": "a", "component": "x"}), "a", "left").join(
        part.withColumnsRenamed({"node": "b", "component": "y"}), "b", "left")
    each = ends.groupBy("b").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("x") == F.col("y"), F.lit(False)).cast("long")).alias("found"))
    classes = each.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("nodes"), F.avg(F.col("found") / F.col("n")).alias("recall"))
    return [(r["nodes"], r["recall"]) for r in classes.collect()]  # 64 rows at most


def _tables(tables: int, bits: int, threshold: float) -> int:
    """At least ``tables``, and so many that a pair at the threshold shares a bucket of
    one of them with a chance of ``GOOD_RECALL`` (for vectors whose mean is near 0)."""
    same = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return tables if same >= GOOD_RECALL or same <= 0 else max(tables, math.ceil(math.log(1 - GOOD_RECALL) / math.log(1 - same)))


def _count_links(nodes: DataFrame, part: DataFrame, threshold: float) -> DataFrame:
    """(node, others): rows of other nodes of the component at ``threshold`` or more."""
    sizes = part.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = part.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("component", F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "node", "own", "with")
    full = cells.join(nodes.select("node", "copies", "e"), "node").select("cell", "node", "own", "with", "copies", "e")

    def count(t: pa.Table) -> dict | None:
        own, other = t.column("own").to_numpy(), t.column("with").to_numpy()
        x, node, copies = unit_rows(t.column("e").combine_chunks()), t.column("node").to_numpy(), t.column("copies").to_numpy()
        linked = (x @ x.T) >= threshold
        # a cell of two blocks counts across, a cell of one block inside
        linked &= (own[:, None] != own[None, :]) | (own == other)[:, None]
        linked &= node[:, None] != node[None, :]
        return {"node": node, "others": linked @ copies}

    schema = pa.schema([("node", pa.int64()), ("others", pa.int64())])
    counted = full.repartition("cell").sortWithinPartitions("cell").mapInArrow(by_run(count, schema), "node long, others long")
    return counted.groupBy("node").agg(F.sum("others").alias("others"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 k: int = K, tables: int = TABLES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    n_links counts other rows, copies included. Vectors that are null, empty, zero
    or hold a null or non-finite component, and rows with a null id, link with
    nothing and are their own component; vectors of different dimension don't
    link. Rows that repeat an id are rows of their own.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, rows=4_096)
    e = F.col(f"`{vec_col}`")
    fine = F.coalesce(F.col(f"`{id_col}`").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
                      & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), e.alias("e"), F.when(fine, F.xxhash64(e)).alias("node"),
                          F.xxhash64(F.lit(7), e).alias("proof"))
    same = F.when(F.min("proof") == F.max("proof"), F.min("vec_id")).otherwise(F.raise_error("two vectors with one hash"))
    nodes = materialize(rows.filter("node is not null").groupBy("node").agg(
        same.alias("least"), F.count("*").alias("copies"), F.first("e").alias("e")).withColumn("dim", F.size("e")), "nodes")
    n = nodes.count()
    bits = max(0, round(math.log2(max(1, n) / BUCKET)))
    first = _tables(tables, bits, threshold)
    strangers = max(1, first // max(1, tables))

    means = nodes.select("dim", F.posexplode("e").alias("i", "v"), F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("norm"))
    mean: dict[int, np.ndarray] = {}
    for r in means.groupBy("dim", "i").agg(F.avg(F.col("v").cast("double") / F.col("norm")).alias("m")).collect():  # a number a dimension
        mean.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["m"] if math.isfinite(r["m"]) else 0.0

    pairs = materialize(_meet(_table_cells(nodes, None, first, bits, mean, 0), k, threshold), "pairs")
    links = pairs.filter(F.col("sim") >= threshold).select("a", "b")
    lists = materialize(_lists(pairs, k), "lists")
    part = materialize(components(links), "parts")
    below, true, classes = part.filter("node <> component").count(), None, []
    for step in range(1, rounds + 1):
        bars = materialize(_bars(lists, k), "bars")
        around = lists.select(F.col("node").alias("hub"), F.col("other").alias("node")).union(
            lists.select(F.col("other").alias("hub"), "node")).distinct()
        hoods = _with_vectors(_dealt(around, ["hub"], CELL // 4, step).select("cell", "node"), nodes, bars)
        found = materialize(_meet(hoods, k, threshold).union(
            _meet(_table_cells(nodes, bars, strangers, bits, mean, step), k, threshold)), "pairs")
        links = materialize(links.union(found.filter(F.col("sim") >= threshold).select("a", "b")).distinct(), "links")
        part = materialize(components(links), "parts")
        before, below = below, part.filter("node <> component").count()  # grows by one with every merge
        asked = _true_links(nodes, step, threshold)
        true = asked if true is None else true.union(asked)
        classes = _audit(true, part)
        settled = below == before and sum(c for c, _ in classes) >= LINKED
        if all(r >= GOOD_RECALL for _, r in classes) and (settled or step * AUDIT_QUERIES >= n):
            break
        lists = materialize(_lists(lists.select(F.col("node").alias("a"), F.col("other").alias("b"), "sim").union(found), k), "lists")
    else:
        linked = sum(c for c, _ in classes)
        recall = min([sum(c * r for c, r in classes) / max(1, linked), *[r for c, r in classes if c >= LINKED]])
        if linked and recall < MIN_RECALL:
            raise RuntimeError(f"recall {recall:.3f} of the audit is under {MIN_RECALL}: raise tables or rounds")

    counts = _count_links(nodes, part, threshold)
    known = nodes.select("node", "least", "copies").join(part, "node", "left").join(counts, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(known.join(names, "component").select(
        "node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")), "classes")
    out = rows.select("vec_id", "node").join(final, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))


#: All links by brute force, in DuckDB (small tables only).
LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
      WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS node FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT vec_id, min(node) AS component FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT t.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, coalesce(c.component, t.vec_id) AS component_id,
       t.vec_id = coalesce(c.component, t.vec_id) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN c ON c.vec_id = t.vec_id
"""
