"""Periodic runs of words by block convolution, and texts with the repeats cut out.

A run is a stretch of words with smallest period q, at least ``MIN_WORDS`` words and
``MIN_TURNS`` turns long, that no neighbouring word extends. At the dyadic scale L the
words are cut into blocks of L; a run of period q in [L, 2L) (at the first scale: of any
period under 2L) holds a whole block that stands again q words later. So the squared
differences of each block and the window after it are summed at all those distances at
once, as a correlation by a number-theoretic transform: exact integers modulo a prime.
A sum of zero is an occurrence; its distance seeds an extension to both sides, word by
word, which gives the run and rejects a sum that is zero only modulo the prime.

Two exact shortcuts keep the work near linear. A block whose words don't all come back
within 2L words has no zero, so it isn't transformed. And an occurrence inside a run
that is known, at a multiple of its period, extends to that run and isn't extended again.
The texts of an Arrow batch are joined, each ended by a word of its own, which no run
can hold; so numpy works on long arrays however short the texts are. No shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from fractions import Fraction
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rows import CRC_TABLE_SQL, WORD, crc32_sql, map_batches

MIN_WORDS = 24
MIN_TURNS = 3
#: 15 * 2^27 + 1: has roots of unity of order 2^27, and products fit 64 bits.
PRIME = 15 * 2**27 + 1
ROOT = 31
#: Blocks are transformed in parts of so many words.
PART = 1 << 20

Run = tuple[int, int, int]  # start, length, period


def _powers(step: int, count: int) -> np.ndarray:
    """step^0 .. step^(count - 1), by doubling."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(step, len(out), PRIME)) % PRIME])
    return out[:count]


def transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of every row (a power of two long), in bit-reversed order."""
    n, size = rows.shape
    half = size // 2
    while half:
        w = _powers(pow(ROOT, (PRIME - 1) // (2 * half), PRIME), half)
        pair = rows.reshape(n, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1]
        rows = np.stack([(a + b) % PRIME, (a + (PRIME - b)) * w % PRIME], axis=2)
        half //= 2
    return rows.reshape(n, size)


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows that ``transform`` turned into ``rows``."""
    n, size = rows.shape
    half = 1
    while half < size:
        w = _powers(pow(ROOT, PRIME - 1 - (PRIME - 1) // (2 * half), PRIME), half)
        pair = rows.reshape(n, -1, 2, half)
        a, b = pair[:, :, 0], pair[:, :, 1] * w % PRIME
        rows = np.stack([(a + b) % PRIME, (a + (PRIME - b)) % PRIME], axis=2)
        half *= 2
    return rows.reshape(n, size) * np.uint64(pow(size, -1, PRIME)) % PRIME


def zero_mismatches(words: np.ndarray, starts: np.ndarray, block: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of all distances in [first, 2 * block) at which the block of
    ``words`` at a start stands again, up to sums that are zero only modulo the prime."""
    size = 1 << (3 * block - 2 - first).bit_length()  # the window has 3 * block - 1 - first words
    span = 2 * block - first
    last = len(words) - 1
    squares = np.concatenate([[np.uint64(0)], np.cumsum(words * words % PRIME, dtype=np.uint64)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(starts), max(1, PART // size)):
        s = starts[at:at + max(1, PART // size)]
        own = np.zeros((len(s), size), dtype=np.uint64)
        # reversed, so that the product of the transforms is the correlation
        own[:, (-np.arange(block)) % size] = words[s[:, None] + np.arange(block)]
        window = words[np.minimum(s[:, None] + first + np.arange(size), last)]
        cross = inverse(transform(own) * transform(window) % PRIME)[:, :span]
        to = np.minimum(s[:, None] + first + np.arange(span), last)
        sums = (squares[s + block] - squares[s])[:, None] + squares[np.minimum(to + block, last + 1)] - squares[to]
        row, d = np.nonzero((sums % PRIME + 2 * (PRIME - cross)) % PRIME == 0)
        found.append((s[row], d + first))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def _reach(words: np.ndarray, at: int, d: int, step: int) -> int:
    """How many words from ``at`` on, in the direction ``step``, equal the word d later."""
    n, take = 0, 32
    while True:
        if step > 0:
            a, b = words[at + n:at + n + take], words[at + n + d:at + n + d + take]
            a = a[:len(b)]
        else:
            low = max(0, at - n - take + 1)
            a, b = words[low:at - n + 1][::-1], words[low + d:at - n + 1 + d][::-1]
        differ = a != b
        if differ.any():
            return n + int(differ.argmax())
        n += len(a)
        if len(a) < take:
            return n
        take *= 2


def runs_of(words: np.ndarray, min_words: int = MIN_WORDS, turns: int = MIN_TURNS) -> list[Run]:
    """All runs of an array of word numbers (non-negative, under 2^31, the last word unlike all others)."""
    if turns < 3:
        raise ValueError("a run of fewer than 3 turns may hold no whole block and its copy")
    n = len(words)
    words = words.astype(np.uint64)
    order = np.argsort(words, kind="stable")
    back = np.full(n, n, dtype=np.int64)  # distance to the next equal word
    same = words[order[1:]] == words[order[:-1]]
    back[order[:-1][same]] = (order[1:] - order[:-1])[same]
    # a run of the least length holds a block of the first scale and its copy under 2 * block words later
    block = 1 << max(0, (min_words // turns).bit_length() - 1)
    first, stretches = 1, {}
    known = np.full(n, -1, dtype=np.int64)  # number of the last run found over a word
    runs: list[Run] = []
    while turns * first <= n and block <= n:
        blocks = n // block
        most = back[:blocks * block].reshape(blocks, block).max(axis=1)
        starts, far = zero_mismatches(words, np.flatnonzero(most < 2 * block) * block, block, first)
        if runs and len(starts):
            a, length, q = np.array(runs, dtype=np.int64)[known[starts]].T
            new = (known[starts] < 0) | (far % q != 0) | (starts + far + block > a + length)
            starts, far = starts[new], far[new]
        done: dict[int, int] = {}  # end of the last stretch by distance
        for k in np.lexsort((starts, far)):
            s, d = int(starts[k]), int(far[k])
            if s + block <= done.get(d, 0):
                continue
            if known[s] >= 0:
                a, length, q = runs[known[s]]
                if d % q == 0 and s + d + block <= a + length:
                    continue
            right = _reach(words, s, d, 1)
            if right == 0:
                continue
            left = _reach(words, s - 1, d, -1) if s else 0
            done[d] = s + right
            a, length = s - left, left + right + d
            if length >= max(min_words, turns * d):
                if d < stretches.get((a, length), n):
                    stretches[a, length] = d
                    runs.append((a, length, d))
                    known[a:a + length] = len(runs) - 1
        first = 2 * block
        block *= 2
    return sorted((a, length, q) for (a, length), q in stretches.items())


def find_runs(texts: list[list[bytes]], min_words: int = MIN_WORDS, turns: int = MIN_TURNS) -> list[list[Run]]:
    """The runs of every list of words, by start and period."""
    number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    words = np.empty(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.int64)
    for k, t in enumerate(texts):
        words[ends[k] - len(t):ends[k]] = np.fromiter(map(number.__getitem__, t), dtype=np.int64, count=len(t))
        words[ends[k]] = len(number) + k
    out: list[list[Run]] = [[] for _ in texts]
    if len(words):
        runs = runs_of(words, min_words, turns)
        for k, (a, length, q) in zip(np.searchsorted(ends, [r[0] for r in runs]), runs):
            out[k].append((a - int(ends[k]) + len(texts[k]), length, q))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first turn."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for a, length, q in runs:
        edge[a + q] += 1
        edge[a + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


SCHEMA = ("doc_id long, runs array<struct<start:long,length:long,period:long>>, "
          "most struct<start:long,length:long,period:long>, collapsed string")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  min_words: int = MIN_WORDS, turns: int = MIN_TURNS) -> DataFrame:
    """Per row of ``docs``: doc_id, ``runs`` by start and period, ``most`` (the run of the
    greatest length / period, ties by start, then period; null without runs) and
    ``collapsed``, the words left, joined by one space.

    ``rewrite`` (id, words) -> words is applied to the words first. Words are those between
    ASCII white space. Null and empty texts have no words, no runs and an empty collapsed
    text. Rows are independent: repeated ids or rows give a row each, null ids stay null, an
    empty table gives an empty table; other columns of ``docs`` are left out.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_pylist()
        texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
        if rewrite is not None:
            texts = [rewrite(d, t) for d, t in zip(ids, texts)]
        found = find_runs(texts, min_words, turns)
        as_dict = lambda r: dict(zip(("start", "length", "period"), r))
        most = [max(rs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if rs else None for rs in found]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([[as_dict(r) for r in rs] for rs in found], pa.list_(_RUN)),
            pa.array([r and as_dict(r) for r in most], _RUN),
            pa.array([b" ".join(collapsed(t, rs)).decode("utf-8", "surrogatepass") for t, rs in zip(texts, found)], pa.string()),
        ], names=["doc_id", "runs", "most", "collapsed"])

    return map_batches(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")), run, SCHEMA)


def planted_turns(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words as the query reads them: in a tenth of the documents, by the CRC of the
    id, the words from some point on are a passage repeated (null ids: unchanged)."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    turn = words[a:a + p]
    return words[:a] + (turn * ((n - a) // len(turn) + 1))[:n - a]


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ``collapse_runs`` over the words of ``planted_turns``."""
    found = collapse_runs(docs, id_col, text_col, rewrite=planted_turns)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "most.start", "most.length", "most.period",
        F.expr("most.length * 1000 div most.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: ``run_report`` in DuckDB: stretches of equal words at each distance, whatever their number.
RUNS_SQL = f"""
WITH {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
h AS (SELECT rid, doc_id, w, len(w) AS n, {crc32_sql("doc_id::VARCHAR")} AS h FROM d, crc),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM g),
x AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w
      ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
u AS (SELECT rid, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
m AS (SELECT a.rid, b.i - a.i AS q, a.i FROM u a JOIN u b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m),
r AS (SELECT rid, start, length, min(q) AS period FROM
      (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY rid, q, island) z
      WHERE length >= greatest({MIN_WORDS}, {MIN_TURNS} * q) GROUP BY rid, start, length),
best AS (SELECT rid, start, length, period FROM r
         QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
left_over AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (rid) LEFT JOIN listed USING (rid) LEFT JOIN left_over USING (rid)
"""
