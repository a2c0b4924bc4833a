"""Byte-level BPE: encoding by a segment tree of pair ranks, and decoding.

A piece (one match of the split pattern) starts as its bytes. A segment tree
over byte positions stores the least (rank, position) of the live pairs, a pair
being the token that starts at the position and the live one after it; the
root is the leftmost pair of least rank. A merge retires the right token's
position and updates two leaves, the merged token's pair and the one before it:
three paths of logarithmic length, so a piece of n bytes costs n log n even if
it is a megabyte without white space.

Pieces repeat, so each worker keeps the encoded ones in a bounded cache, and new
pieces of a batch are encoded together: the trees of short pieces are rows of one
array and numpy makes one merge in every tree at once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .rows import bounded_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces a worker keeps (some 250 bytes each), and the longest kept.
CACHE = 300_000
CACHED_CHARS = 64
#: Pieces up to this many bytes are encoded in numpy rows, longer ones singly.
ROW_BYTES = 64
NONE = np.iinfo(np.int64).max


class Ranks:
    """Ranks of a vocabulary file and the pairs of tokens that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {v: k for k, v in self.rank.items()}
        # a merge of two tokens makes the token of their joined bytes, whose rank is the pair's
        pairs = [(self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items()
                 for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank]
        self.pair_rank = dict(pairs)
        self.keys = np.array(sorted(self.pair_rank), dtype=np.int64)
        self.values = np.array([self.pair_rank[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_long(piece: bytes, r: Ranks) -> list[int]:
    """One piece of any length over a tree in a list; node 1 is the root."""
    n = len(piece)
    size = 1 << max(0, n - 1).bit_length()
    token = [r.rank[piece[i:i + 1]] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, shift = r.pair_rank.get, size.bit_length()
    none = (1 << 62) << shift
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (rank := get(token[i] << 32 | token[i + 1])) is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least

    def pair(i: int) -> int:
        if after[i] >= n or (rank := get(token[i] << 32 | token[after[i]])) is None:
            return none
        return rank << shift | i

    while tree[1] < none:
        i = tree[1] & ((1 << shift) - 1)
        token[i] = tree[1] >> shift
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        put(gone, none)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return out


def encode_rows(pieces: list[bytes], r: Ranks) -> list[list[int]]:
    """Many pieces of at most ``size`` bytes, a tree a row; one merge in each per step."""
    m, longest = len(pieces), max(map(len, pieces))
    size = 1 << max(1, longest - 1).bit_length()
    n = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(m, size)
    token = r.single[raw]
    column = np.arange(size)
    after = np.tile(column + 1, (m, 1))
    before = np.tile(column - 1, (m, 1))
    tree = np.full((m, 2 * size), NONE, dtype=np.int64)
    rank = r.of_pairs(token[:, :-1], token[:, 1:])
    rank[column[None, :-1] + 1 >= n[:, None]] = NONE
    tree[:, size:2 * size - 1] = np.where(rank == NONE, NONE, rank * size + column[:-1])
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        k = size + at
        tree[rows, k] = value
        while k[0] > 1:  # all leaves lie equally deep
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    def pairs(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[rows, at]
        inside = nxt < n[rows]
        rank = r.of_pairs(token[rows, at], token[rows, np.where(inside, nxt, 0)])
        return np.where(inside & (rank != NONE), rank * size + at, NONE)

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        best = tree[rows, 1]
        i = best % size
        token[rows, i] = best // size
        gone = after[rows, i]
        later = after[rows, gone]
        after[rows, i] = later
        token[rows, gone] = -1
        inside = later < n[rows]
        before[rows[inside], later[inside]] = i[inside]
        put(rows, gone, np.full(len(rows), NONE))
        put(rows, i, pairs(rows, i))
        prev = before[rows, i]
        inside = prev >= 0
        if inside.any():
            put(rows[inside], prev[inside], pairs(rows[inside], prev[inside]))
        rows = rows[tree[rows, 1] != NONE]
    token[column[None, :] >= n[:, None]] = -1
    live = token >= 0
    flat, cuts = token[live].tolist(), np.concatenate(([0], np.cumsum(live.sum(axis=1)))).tolist()
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def encode_pieces(pieces: Iterable[bytes], r: Ranks) -> list[list[int]]:
    """Ids of each piece; a piece that is a token as a whole is that token."""
    pieces = list(pieces)
    out: list[list[int]] = [[]] * len(pieces)
    classes: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        if (whole := r.rank.get(p)) is not None:
            out[k] = [whole]
        elif len(p) > ROW_BYTES:
            out[k] = encode_long(p, r)
        else:
            classes.setdefault(max(1, (len(p) - 1).bit_length()), []).append(k)
    for members in classes.values():
        for at in range(0, len(members), 4096):
            part = members[at:at + 4096]
            for k, ids in zip(part, encode_rows([pieces[i] for i in part], r)):
                out[k] = ids
    return out


class Encoder:
    """Texts to ids and back, with a bounded cache of short pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.find = ranks(path), regex.compile(pattern).findall
        self.known: dict[str, tuple[bytes, str]] = {}

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Per text: ids as little-endian 32-bit integers, ids in decimal."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.find(t) for t in texts]
        new = list({p for s in split for p in s if p not in self.known})
        extra: dict[str, tuple[bytes, str]] = {}
        for piece, ids in zip(new, encode_pieces([p.encode("utf-8", "surrogatepass") for p in new], self.ranks)):
            entry = array("I", ids).tobytes(), ",".join(map(str, ids))
            (self.known if len(piece) <= CACHED_CHARS else extra)[piece] = entry
        known, found = self.known, []
        for s in split:
            parts = [known.get(p) or extra[p] for p in s] if extra else list(map(known.__getitem__, s))
            found.append((b"".join([x[0] for x in parts]), ",".join([x[1] for x in parts])))
        return found

    def decode(self, ids: bytes) -> bytes:
        table = self.ranks.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, so the cache outlives a task."""
    return Encoder(path, pattern)


def _groups(texts: pa.Array, most_chars: int = 2_000_000) -> Iterable[list[str]]:
    held, chars = [], 0
    for t in texts:
        text = t.as_py() or ""
        if held and chars + len(text) > most_chars:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def encode(text: Column, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Array of ids of a text column (null: of the empty text).

    ``vocabulary`` is the path of a rank file that every executor can read."""
    name = vocabulary

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(name or public_tokenizers.path(VOCABULARY), pattern)
        found = [x for group in _groups(texts) for x in e.encode(group)]
        ids = np.frombuffer(b"".join(x[0] for x in found), dtype="<u4").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[0]) // 4 for x in found]), pa.int32()), pa.array(ids))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>").asNondeterministic()(text)


def decode(ids: Column, vocabulary: str | None = None) -> Column:
    """Bytes of an array of ids (null: null). An unknown id raises."""
    name = vocabulary

    def run(lists: pa.Array) -> pa.Array:
        table = ranks(name or public_tokenizers.path(VOCABULARY)).bytes
        return pa.array([None if x.as_py() is None else b"".join([table[i] for i in x.as_py()]) for x in lists], pa.binary())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary").asNondeterministic()(ids)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
               pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, SHA-256 of the decimal ids joined by
    commas and of the bytes that the ids decode to.

    The ids stay in the worker that makes them; only the digests leave it, and no
    shuffle is needed. Null and empty texts have no ids."""
    bounded_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        e = encoder(vocabulary or public_tokenizers.path(VOCABULARY), pattern)
        rows = [(len(ids) // 4, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest())
                for group in _groups(texts) for ids, decimal in e.encode(group)]
        n, a, b = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                          names=["n_tokens", "ids_sha256", "decoded_sha256"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    digest = F.arrow_udf(run, DIGEST).asNondeterministic()(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), digest.alias("d")).select("doc_id", "d.*")
