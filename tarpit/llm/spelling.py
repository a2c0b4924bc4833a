"""Spelling variants of words, grouped by k-d trees over letter counts.

Words that differ by one letter have letter counts at an L1 distance of at most two: two if
one letter is replaced by another, one if a letter is put in or left out. So for each pair
of word lengths (n, n) and (n, n + 1) the words are points in the space of letter counts,
and the candidates of a word are a range search in a k-d tree, pruned by the distance of
the word to a node's box. Candidates are verified letter by letter.

The trees are spread over the cluster: their upper levels, one tree a word length, are
fitted on a sample of bounded size (``SAMPLE`` words), which settles only where words
go. Every word goes to the cell of its counts, and as a query to each cell whose box is
near enough. In a cell, the lower levels are a tree over all of its words.

Words come from a count over all texts, added up in each task before the shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.common import materialize
from .rows import CRC_TABLE_SQL, bounded_batches, crc32_sql

#: A word: a run of Latin letters (with the two signs between them).
LETTERS = "A-Za-zÀ-ÿ"
MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form is at least so many times as frequent.
TIMES = 5
#: Words that the upper levels of the trees are fitted on, about.
SAMPLE = 1 << 16
#: Words of the sample in a cell of the upper levels, about, and words in a leaf of the lower ones.
CELL = 1 << 10
LEAF = 32
#: Different words that a task counts before it hands them on.
HELD = 1 << 18

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Dimensions: a-z, then the code points from U+00C0 on.
DIMS = 26 + 64


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rewrite: Callable[[int | None, str], str] | None = None, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n) over all texts: lower-cased (A-Z only) words of ``min_letters`` or more.

    ``rewrite`` (id, word) -> word is applied to each lower-cased word of a document, of
    any length. Null and empty texts have no words; repeated rows count each.
    """
    bounded_batches(docs.sparkSession)
    find = re.compile(f"[{LETTERS}]+").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(find((text or "").translate(_LOWER))).items():
                    if rewrite is not None:
                        word = rewrite(doc_id, word)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    parts = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8).reshape(len(words), -1)
    return np.where(codes < 0xC0, codes - np.uint8(ord("a")), codes - np.uint8(0xC0 - 26))


def counts_of(codes: np.ndarray) -> np.ndarray:
    """Letter counts of rows of letter numbers."""
    n = len(codes)
    flat = (np.arange(n)[:, None] * DIMS + codes).ravel()
    return np.bincount(flat, minlength=n * DIMS).reshape(n, DIMS).astype(np.int16)


class Node:
    """A k-d tree node: points with ``counts[dim] < cut`` go left; a leaf has neither child."""

    __slots__ = ("dim", "cut", "left", "right", "points")

    def __init__(self, points: np.ndarray):
        self.points, self.left, self.right = points, None, None


def _split(counts: np.ndarray) -> tuple[int, int] | None:
    """Dimension and cut that part the points most evenly; None if all points are equal."""
    best, n = None, len(counts)
    for cut in range(1, int(counts.max(initial=0)) + 1):
        low = (counts < cut).sum(axis=0)
        even = np.minimum(low, n - low)
        dim = int(even.argmax())
        if even[dim] and (best is None or even[dim] > best[0]):
            best = (int(even[dim]), dim, cut)
        if best is not None and best[0] * 3 >= n:
            break
    return best and best[1:]


def build(counts: np.ndarray, leaf: int) -> Node:
    """k-d tree over rows of letter counts with at most ``leaf`` points a leaf (more if equal)."""
    root = Node(np.arange(len(counts)))
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.points) > leaf and (split := _split(counts[node.points])):
            node.dim, node.cut = split
            low = counts[node.points, node.dim] < node.cut
            node.left, node.right = Node(node.points[low]), Node(node.points[~low])
            node.points = None
            todo += [node.left, node.right]
    return root


def search(root: Node, counts: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, numbers of the queries whose L1 distance to the leaf's box is at most ``radius``)."""
    every = np.arange(len(counts))
    # per node: the queries, their distance to its box, and the box's bounds where it has any
    todo = [(root, every, np.zeros(len(counts), dtype=np.int16), {})]
    while todo:
        node, who, far, box = todo.pop()
        if not len(who):
            continue
        if node.left is None:
            yield node, who
            continue
        at = counts[who, node.dim]
        low, high = box.get(node.dim, (0, 1 << 14))
        rest = far - np.maximum(0, np.maximum(low - at, at - high))
        for child, lo, hi in ((node.left, low, node.cut - 1), (node.right, node.cut, high)):
            to = rest + np.maximum(0, np.maximum(lo - at, at - hi))
            near = to <= radius
            todo.append((child, who[near], to[near], box | {node.dim: (lo, hi)}))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: row of a and row of b (same length) differ at exactly one place. Eight letters, each
    under 128, are compared as one number: 127 more carries a byte's top bit unless it is zero."""
    a, b = (np.pad(x, ((0, 0), (0, -x.shape[1] % 8))).view(np.uint64) for x in (a, b))
    places = np.zeros((len(a), len(b)), dtype=np.uint8)
    for x, y in zip(a.T, b.T):
        places += np.bitwise_count(((x[:, None] ^ y) + np.uint64(0x7F7F7F7F7F7F7F7F)) & np.uint64(0x8080808080808080))
    return places == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix: row of b is row of a with one letter put in."""
    same = a[:, None, :] == b[None, :, :-1]
    moved = a[:, None, :] == b[None, :, 1:]
    head = np.logical_and.accumulate(same, axis=2).sum(axis=2)
    tail = np.logical_and.accumulate(moved[:, :, ::-1], axis=2).sum(axis=2)
    return head + tail >= a.shape[1]


def near_pairs(points: list[str], queries: list[str], leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the queries and points that are one edit apart: points of one length, queries
    of the same or of one letter less."""
    own, asked = letters(points), letters(queries)
    grown = own.shape[1] - asked.shape[1]
    differ, radius = (one_inserted, 1) if grown else (one_replaced, 2)
    asked_counts = counts_of(asked)
    q, p = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for node, who in search(build(counts_of(own), leaf), asked_counts, radius):
        step = max(1, (1 << 22) // (len(node.points) * own.shape[1]))
        for at in range(0, len(who), step):
            i, j = np.nonzero(differ(asked[who[at:at + step]], own[node.points]))
            q.append(who[at + i])
            p.append(node.points[j])
    return np.concatenate(q), np.concatenate(p)


_CELLS = "cell string, grown int, query boolean, word string, n long"
_NEAR = "word string, n_near long, best_n long, best string"


def _upper_trees(words: DataFrame, sample: int, cell: int) -> dict[int, Node]:
    """A tree of few leaves for each word length, from a sample of bounded size."""
    n = words.count()
    # by the hash, so that each run takes the same ones; about ``sample`` of more words, all of fewer
    below = F.lit(min(2**62, 2**62 * sample // max(1, n)))
    some = [r.word for r in words.filter(F.shiftrightunsigned(F.xxhash64("word"), 2) < below).select("word").collect()] if n else []
    by_length: dict[int, list[str]] = {}
    for w in some:
        by_length.setdefault(len(w), []).append(w)
    trees = {}
    for n, own in by_length.items():
        trees[n] = build(counts_of(letters(own)), cell)
        todo, k = [trees[n]], 0
        while todo:
            node = todo.pop()
            if node.left is None:
                node.points, k = k, k + 1  # its number
            else:
                todo += [node.left, node.right]
    return trees


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``words`` (word, n), distinct -> (word, n_near, best_n, best) of the words with a near word:
    how many there are and the most frequent one, ties the smallest."""
    trees = _upper_trees(words, sample, cell)
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = sent.value
        for batch in batches:
            all_words, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = np.array([len(w) for w in all_words])
            out: list[tuple] = []
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                counts = counts_of(letters([all_words[k] for k in at]))
                # its own cell, then as a query the cells near it of its length and of one letter more
                for length, radius, query in ((n, 0, False), (n, 2, True), (n + 1, 1, True)):
                    for node, who in search(upper.get(length) or _ONE_CELL, counts, radius):
                        out += [(f"{length}:{node.points}", length - n, query, all_words[k], int(ns[k])) for k in at[who]]
            # a point serves both searches of its cell
            out += [(c, 1, False, w, m) for c, g, is_query, w, m in out if not is_query]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CELL_TYPES)], names=_CELL_NAMES)

    def match(key: tuple, rows: pa.Table) -> pa.Table:
        query = rows.column("query").to_numpy()
        all_words, ns = np.array(rows.column("word").to_pylist(), dtype=object), rows.column("n").to_numpy()
        points, queries = np.flatnonzero(~query), np.flatnonzero(query)
        if not len(points) or not len(queries):
            return pa.table([pa.array([], t) for t in _NEAR_TYPES], names=_NEAR_NAMES)
        q, p = near_pairs(all_words[points].tolist(), all_words[queries].tolist())
        q, p = queries[q], points[p]
        if key[1].as_py():  # the longer word has the shorter one as a near word, too
            q, p = np.concatenate([q, p]), np.concatenate([p, q])
        order = np.lexsort((all_words[p].astype(str), -ns[p], q))
        q, p = q[order], p[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, dtype=np.int64)
        sizes = np.diff(np.append(first, len(q)))
        return pa.table([pa.array(all_words[q[first]], pa.string()), pa.array(sizes, pa.int64()), pa.array(ns[p[first]], pa.int64()),
                         pa.array(all_words[p[first]], pa.string())], names=_NEAR_NAMES)

    bounded_batches(words.sparkSession, rows=1 << 14)
    cells = words.select("word", "n").mapInArrow(spread, _CELLS)
    found = cells.groupBy("cell", "grown").applyInArrow(match, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


_ONE_CELL = Node(0)
_CELL_NAMES, _CELL_TYPES = ["cell", "grown", "query", "word", "n"], [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
_NEAR_NAMES, _NEAR_TYPES = ["word", "n_near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]


def spelling_groups(words: DataFrame, times: int = TIMES, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """``words`` (word, n), distinct words of the letters of ``LETTERS`` in lower case ->
    word, form, root, n, n_near, form_n.

    ``form`` is the near word of the largest n (ties: the smallest by code points) if that
    is ``times`` n or more, else null; ``root`` is where the forms lead, the word itself
    without one. ``times`` is 2 or more, so that forms lead nowhere back and a path has at
    most 63 steps. An empty table gives an empty table.
    """
    if times < 2:
        raise ValueError("a form is at least twice as frequent")
    words = materialize(words.select("word", "n"), "words")
    near = words.join(near_words(words, sample, cell), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    out = materialize(near.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    # every round doubles the steps that a word has gone
    goes = out.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(6):
        step = goes.select(F.col("word").alias("root"), F.col("root").alias("next"))
        goes = materialize(goes.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                  F.col("next").isNotNull().alias("moved")), "roots")
        if goes.filter("moved").isEmpty():
            break
    return out.join(goes.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted_typo(doc_id: int | None, word: str) -> str:
    """The word as the query reads it: where 199 divides the CRC of id and word, a letter is
    left out (null ids: unchanged)."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 199:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1:]


def spelling_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variant groups of the words of all texts that occur ``MIN_COUNT`` times or more."""
    return spelling_groups(word_counts(docs, id_col, text_col, planted_typo).filter(F.col("n") >= MIN_COUNT))


#: ``spelling_report`` in DuckDB: near words share a word with one letter left out.
SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
u AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')) AS run FROM documents) z GROUP BY 1, 2),
c AS (SELECT run, n, {crc32_sql("doc_id::VARCHAR || ':' || run")} AS h FROM u, crc),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
o AS (SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w) z),
e AS (SELECT a.word, b.word AS near FROM o a JOIN o b ON a.k = b.k AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
      UNION SELECT o.word, w.word FROM o JOIN w ON o.rest = w.word
      UNION SELECT w.word, o.word FROM o JOIN w ON o.rest = w.word),
f AS (SELECT e.word, count(*) AS n_near, first(e.near ORDER BY w.n DESC, encode(e.near)) AS best, max(w.n) AS best_n FROM e JOIN w ON e.near = w.word GROUP BY e.word),
s AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {TIMES} * w.n THEN best END AS form,
             CASE WHEN best_n >= {TIMES} * w.n THEN best_n END::BIGINT AS form_n FROM w LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, form AS next FROM s UNION ALL SELECT r.word, s.word, s.form FROM r JOIN s ON r.next = s.word)
SELECT s.word, s.form, r.root, s.n, s.n_near, s.form_n FROM s JOIN r ON r.word = s.word AND r.next IS NULL
"""
