"""Substring dedup by fixed-block anchors.

A repeat is a window of ``WINDOW`` words that also starts earlier: in a document with a
smaller id, or before in the same one. Words of repeats go, the earliest stays.

* Index: every document is cut into blocks of half a window, not overlapping. A whole
  window holds at least one of its document's blocks, wherever it starts.
* Probe: every rolling half window of every document is looked up among the blocks. A
  window without a hit, on a block that also stands elsewhere, has no twin.
* Extend: the windows around hits are compared as wholes. Adjacent equal windows join up
  to the maximal exact repeats, which needs no pairs: of equal windows only the
  earliest matters, however many copies there are.

Texts move once, into batches of bounded size by the hash of the row. What moves from
there are sorted hashes of a batch, cut into ranges and stored as differences (about three
bytes a word), and bitmaps back. A range has a bounded number of hashes whatever the
size of the corpus; a hash is sent once a batch, so a hot passage is one value a batch.
Half windows are compared by as many bits as the corpus needs (more only save work), whole
windows by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .rows import WORD, bounded_batches

WINDOW = 20
#: Code points of text in a batch, and in the batches that share a range of hashes, on average.
BATCH_CHARS = 8 << 20
RANGE_CHARS = 16 << 20
_STEP = 0x9E3779B97F4A7C15  # odd, so that powers of it never vanish


def _wrap(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _wrap(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * _wrap(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` consecutive word hashes, by doubling widths."""
    total, done, power, size = None, 0, words, 1
    while done < width:
        if width & size:
            # the polynomial of ``done`` words, then that of ``size`` more
            total = power if total is None else total[:len(power) - done] * _wrap(pow(_STEP, size, 1 << 64)) + power[done:]
            done += size
        if done < width:
            if len(power) <= size:
                return np.empty(0, dtype=np.uint64)
            power = power[:-size] * _wrap(pow(_STEP, size, 1 << 64)) + power[size:]
            size *= 2
    return _mix(total[:max(0, len(words) - width + 1)])


def pack(values: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted distinct values as (first, bytes a difference, differences)."""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return int(values[:1].view(np.int64)[0]), width, steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(first: int, width: int, data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // width + 1, 8), dtype=np.uint8)
    steps[1:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    steps = steps.view("<u8").ravel().astype(np.uint64)
    steps[0] = np.array([first], dtype=np.int64).view(np.uint64)[0]
    return np.cumsum(steps, dtype=np.uint64)


class Batch:
    """The texts of a batch as one array of word hashes, documents in their order."""

    def __init__(self, rows: pa.Table, window: int, ranges: int, bits: int):
        self.window, self.half, self.ranges = window, window // 2, ranges
        ids, keys = rows.column("doc_id").to_pylist(), rows.column("row_key").to_pylist()
        # rows that are equal in id and text are one document
        docs = sorted({(d is None, d or 0, k): row for row, (d, k) in enumerate(zip(ids, keys))}.items())
        place = {k: at for at, (k, _) in enumerate(docs)}
        self.rows = [place[d is None, d or 0, k] for d, k in zip(ids, keys)]
        self.ids = ids
        self.order = np.array([k for k, _ in docs], dtype=np.int64).reshape(-1, 3)  # null last, id, row key
        column = rows.column("text")
        self.words = [(column[row].as_py() or "").encode("utf-8", "surrogatepass").split() for _, row in docs]
        number = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(self.words)))}
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), dtype=np.uint64, count=len(number))
        self.ends = np.cumsum([len(w) for w in self.words]) if docs else np.zeros(0, dtype=np.int64)
        n = int(self.ends[-1]) if docs else 0
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(self.words)), dtype=np.int64, count=n)
        self.hashes = hashes[flat]
        self.doc = np.repeat(np.arange(len(docs)), [len(w) for w in self.words])
        starts = np.array([len(w) for w in self.words], dtype=np.int64)
        starts = self.ends - starts
        short = window_hashes(self.hashes, self.half) >> np.uint64(64 - bits)
        at = np.flatnonzero(self.ends[self.doc[:len(short)]] - np.arange(len(short)) >= self.half)
        self.probes, inverse, counts = np.unique(short[at], return_inverse=True, return_counts=True)
        self.blocks = np.zeros(len(self.probes), dtype=bool)
        self.blocks[inverse[(at - starts[self.doc[at]]) % self.half == 0]] = True
        self.twice = self.blocks & (counts > 1)
        self.probe_at, self.probe_of = at, inverse
        self.cuts = cuts(self.probes, bits, ranges)

    def candidates(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows around hits: start of each, its distinct value's number; the
        distinct values and the first window of each."""
        hit = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        hit[self.probe_at] = (hits | self.twice)[self.probe_of]
        before = np.concatenate([[0], np.cumsum(hit)])
        whole = window_hashes(self.hashes, self.window)
        at = np.arange(len(whole))
        near = before[at + self.window - self.half + 1] > before[at]
        at = at[near & (self.ends[self.doc[:len(whole)]] - at >= self.window)]
        values, first, number = np.unique(whole[at], return_index=True, return_inverse=True)
        return at, number, values, first


def cuts(values: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where the ranges of hashes of ``bits`` bits begin in sorted ``values``, and the end."""
    edges = [-(-(r << bits) // ranges) for r in range(ranges)]
    return np.append(np.searchsorted(values, np.array(edges, dtype=np.uint64)), len(values))


_BITS = "batch long, range long, kind int, bits binary"
_PROBES = "range long, batch long, first long, width int, steps binary, flags binary"
_WINDOWS = "range long, batch long, first long, width int, steps binary, docs binary, orders binary"


def _flagged(tables: pa.Table, cut: np.ndarray, kind: int, n: int) -> np.ndarray:
    """The bitmaps of a kind, laid over n values that are cut into ranges."""
    out = np.zeros(n, dtype=bool)
    for r in tables.to_pylist():
        if r["kind"] == kind:
            a, b = cut[r["range"]], cut[r["range"] + 1]
            out[a:b] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=b - a).astype(bool)
    return out


def _rows(rows: list[tuple], names: str, types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in names.split(", ")])


_L, _I, _B = pa.int64(), pa.int32(), pa.binary()


def _answers(messages: list[dict], flags: np.ndarray, ends: np.ndarray, kind: int) -> pa.Table:
    """A bitmap for every message that has a flag."""
    parts = [flags[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]
    return _rows([(m["batch"], m["range"], kind, np.packbits(p).tobytes()) for m, p in zip(messages, parts) if p.any()],
                 _BITS, [_L, _L, _I, _B])


def shared_blocks(table: pa.Table) -> pa.Table:
    """Of the probes of a range: those that some document has as a block and several batches have."""
    messages = table.to_pylist()
    values = [unpack(m["first"], m["width"], m["steps"]) for m in messages]
    block = np.concatenate([np.unpackbits(np.frombuffer(m["flags"], dtype=np.uint8), count=len(v)) for m, v in zip(messages, values)])
    ends = np.cumsum([len(v) for v in values])
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    starts = np.flatnonzero(np.append(True, flat[order[1:]] != flat[order[:-1]]))
    sizes = np.diff(np.append(starts, len(flat)))
    hit = (sizes > 1) & (np.maximum.reduceat(block[order], starts) > 0)
    flags = np.zeros(len(flat), dtype=bool)
    flags[order] = np.repeat(hit, sizes)
    return _answers(messages, flags, ends, 1)


def later_windows(table: pa.Table) -> pa.Table:
    """Of the windows of a range: those that a batch with an earlier document has too."""
    messages = table.to_pylist()
    values = [unpack(m["first"], m["width"], m["steps"]) for m in messages]
    orders = [np.frombuffer(m["orders"], dtype="<i8").reshape(-1, 3) for m in messages]
    base = np.cumsum([0] + [len(o) for o in orders])[:-1]
    docs = np.concatenate([np.frombuffer(m["docs"], dtype="<u4").astype(np.int64) + b for m, b in zip(messages, base)])
    rank = np.empty(int(base[-1]) + len(orders[-1]), dtype=np.int64)
    every = np.concatenate(orders)
    rank[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))] = np.arange(len(every))
    ends = np.cumsum([len(v) for v in values])
    flat = np.concatenate(values)
    order = np.lexsort((rank[docs], flat))
    flags = np.zeros(len(flat), dtype=bool)
    flags[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    return _answers(messages, flags, ends, 2)


SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_text string"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                batch_chars: int = BATCH_CHARS, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, ``spans`` (word numbers of the
    maximal stretches of removed words) and kept_text (words left, joined by one space).

    Documents are ordered by id, nulls last, rows of one id by the hash of id and text; rows
    equal in both are one document and get the same result each. Null and empty texts
    have no words; texts of fewer words than a window stay. An empty table gives an empty
    table; other columns are left out.
    """
    if window < 2 or window % 2:
        raise ValueError("a window is an even number of words")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    batches, ranges = 1 + chars // batch_chars, 1 + chars // range_chars
    bits = min(64, chars.bit_length() + 10)
    own = F.xxhash64("doc_id", "text")
    texts = texts.select("doc_id", "text", own.alias("row_key"), F.pmod(F.hash(own), F.lit(batches)).cast("long").alias("batch"))

    def probe(key: tuple, rows: pa.Table) -> pa.Table:
        b = Batch(rows, window, ranges, bits)
        out = [(r, key[0].as_py(), *pack(b.probes[x:y]), np.packbits(b.blocks[x:y]).tobytes())
               for r, (x, y) in enumerate(zip(b.cuts[:-1].tolist(), b.cuts[1:].tolist())) if x < y]
        return _rows(out, _PROBES, [_L, _L, _L, _I, _B, _B])

    def extend(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows([], _WINDOWS, [_L, _L, _L, _I, _B, _B, _B])
        b = Batch(rows, window, ranges, bits)
        at, _, values, first = b.candidates(_flagged(answers, b.cuts, 1, len(b.probes)))
        cut, doc = cuts(values, 64, ranges), b.doc[at[first]]
        out = []
        for r, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if x < y:
                some, which = np.unique(doc[x:y], return_inverse=True)
                out.append((r, key[0].as_py(), *pack(values[x:y]), which.astype("<u4").tobytes(), b.order[some].astype("<i8").tobytes()))
        return _rows(out, _WINDOWS, [_L, _L, _L, _I, _B, _B, _B])

    def cut(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], t) for t in (_L, _L, _L, pa.list_(_SPAN), pa.string())], names=names)
        b = Batch(rows, window, ranges, bits)
        at, number, values, first = b.candidates(_flagged(answers, b.cuts, 1, len(b.probes)))
        goes = _flagged(answers, cuts(values, 64, ranges), 2, len(values))[number]
        goes |= first[number] != np.arange(len(at))
        edge = np.zeros(len(b.hashes) + 1, dtype=np.int64)
        edge[at[goes]] += 1  # starts are distinct
        edge[at[goes] + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        found = []
        for words, end in zip(b.words, b.ends.tolist()):
            mask = gone[end - len(words):end]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            left = words if not len(turn) else [words[k] for k in np.flatnonzero(~mask)]
            found.append((len(words), int(mask.sum()), [{"start": x, "stop": y} for x, y in turn.reshape(-1, 2).tolist()],
                          b" ".join(left).decode("utf-8", "surrogatepass")))
        out = [(d, *found[k]) for d, k in zip(b.ids, b.rows)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (_L, _L, _L, pa.list_(_SPAN), pa.string()))], names=names)

    names = [x.split()[0] for x in ("doc_id long", "n_words long", "n_removed long", "spans", "kept_text string")]
    by_batch = texts.groupBy("batch")
    hits = by_batch.applyInArrow(probe, _PROBES).groupBy("range").applyInArrow(shared_blocks, _BITS)
    later = (by_batch.cogroup(hits.groupBy("batch")).applyInArrow(extend, _WINDOWS)
             .groupBy("range").applyInArrow(later_windows, _BITS))
    return by_batch.cogroup(hits.union(later).groupBy("batch")).applyInArrow(cut, SCHEMA)


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and the digest of what ``cut_repeats`` leaves."""
    found = cut_repeats(docs, id_col, text_col)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: ``repeat_report`` in DuckDB: every window with the first place of its words.
REPEATS_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
v AS (SELECT rid, i, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS words FROM (SELECT rid, w, unnest(range(len(w) - {WINDOW - 1})) AS i FROM d) z),
later AS (SELECT rid, i FROM v QUALIFY row_number() OVER (PARTITION BY words ORDER BY rid, i) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS i FROM later),
u AS (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
k AS (SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
