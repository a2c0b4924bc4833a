"""Token ids in binary files: Simple-8b words in blocks of documents.

A 64-bit word is a 4-bit selector and 60 bits that hold as many ids as fit:
60 ids of 1 bit, 30 of 2, ... 3 of 20, 2 of 30 or one of 60. The last selector is
an escape: the next word is one plain 64-bit value. Ids are packed in runs of
``RUN`` that start at a word of their own, and a block lists the word offsets of
its runs, so a reader decodes any run without those before it, all words of one
selector at once in numpy.

A file is a Parquet part whose rows are blocks: the documents' ids and token
counts, the run offsets and the words. Parquet gives the files Spark's commit
protocol, so a lost executor leaves no half-written file, on any file system.
Parts follow the order of doc_id and so do the blocks within.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import shared_path
from .rows import bounded_batches, map_batches

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: Ids per word and their bits, by selector (fixed values of the code).
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = len(SELECTORS)
RUN = 4_096
#: A block is closed when it holds this many ids; a document is never split.
BLOCK_IDS = 1 << 18
#: Chunks of text between white space that a worker keeps (twice, see ChunkEncoder), and the most characters of one kept.
CACHE = 500_000
CACHED = 48
BLOCK_SCHEMA = ("part int, block int, doc_ids array<bigint>, counts array<int>, n_ids long, run_words array<int>, words binary")


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of non-negative 64-bit values, greedily filled."""
    return pack_runs(ids, max(1, len(ids)))[1]


def pack_runs(ids: np.ndarray, run: int = RUN) -> tuple[list[int], np.ndarray]:
    """Word offset of each run of ``run`` ids, and the words of all runs, greedily filled.

    Runs are laid out with room for the widest selector between them, so that one
    numpy step per selector serves all of them."""
    n, gap = len(ids), SELECTORS[0][0]
    if not n:
        return [], np.empty(0, dtype=np.uint64)
    runs = -(-n // run)
    laid = np.zeros((runs, run + gap), dtype=np.uint64)
    laid[:, :run].flat[:n] = ids
    laid = laid.ravel()
    # float64 tells the bit length of values below 2^50 exactly
    bits = np.maximum(1, np.frexp(laid.astype(np.float64))[1]).astype(np.uint8)
    exact = bits > 50
    if exact.any():
        bits[exact] = [int(x).bit_length() for x in laid[exact]]
    ends = [k * (run + gap) + min(run, n - k * run) for k in range(runs)]
    step = np.zeros(len(laid), dtype=np.uint8)  # 0: escape
    kind = np.full(len(laid), ESCAPE, dtype=np.uint8)
    reach, last = bits, 1
    for selector in range(len(SELECTORS) - 1, -1, -1):  # fewest ids first, so that the fullest wins
        count, width = SELECTORS[selector]
        if count > last:  # most bits of the next ``count`` ids: at most twice as many, two windows cover them
            reach = np.maximum(reach[:last - count], reach[count - last:])
            last = count
        fits = np.flatnonzero(reach <= width)
        step[fits], kind[fits] = count, selector
    jump, at, firsts = step.tobytes(), [], []
    for k, end in enumerate(ends):
        i = k * (run + gap)
        firsts.append(len(at))
        while i < end:
            at.append(i)
            i += jump[i] or 1
    at = np.array(at)
    chosen = kind[at]
    place = np.concatenate(([0], np.cumsum(1 + (chosen == ESCAPE))))
    words = np.zeros(place[-1], dtype=np.uint64)
    words[place[:-1]] = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(chosen == selector)
        for k in range(count if len(own) else 0):
            words[place[own]] |= laid[at[own] + k] << np.uint64(k * width)
    own = np.flatnonzero(chosen == ESCAPE)
    words[place[own] + 1] = laid[at[own]]
    return place[firsts].tolist(), words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of ``pack``'s words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    plain = np.zeros(len(words), dtype=bool)
    for k in np.flatnonzero(selector == ESCAPE).tolist():
        if not plain[k]:  # else a plain word that looks like an escape
            plain[k + 1] = True
    counts = np.array([c for c, _ in SELECTORS] + [0, 0])[np.minimum(selector, ESCAPE)]
    counts[plain] = 1
    start = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(start[-1] + 60, dtype=np.uint64)
    for s, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero((selector == s) & ~plain)
        mask = np.uint64((1 << width) - 1)
        for k in range(count if len(own) else 0):
            out[start[own] + k] = (words[own] >> np.uint64(k * width)) & mask
    out[start[:-1][plain]] = words[plain]
    return out[:n]


def unpack_runs(offsets: list[int], words: np.ndarray, n: int) -> np.ndarray:
    ends = [*offsets[1:], len(words)]
    parts = [unpack(words[a:b], min(RUN, n - k * RUN)) for k, (a, b) in enumerate(zip(offsets, ends))]
    return np.concatenate(parts or [np.empty(0, dtype=np.uint64)])


#: Lower-case letters that normalising leaves as they are and that are parts of words, whatever stands beside them.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
#: Chunks that normalising leaves as they are, and the vocabulary's pieces of such chunks.
_SETTLED = re.compile(f"[!-@[-~{_LETTERS}]+")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")


class ChunkEncoder:
    """The tokenizers library over chunks between white space, with a bounded cache.

    The vocabulary's rules lower-case, drop white space and never look across it, so
    a text's ids are those of its chunks in order, ASCII letters in lower case. Arrow
    splits the texts of a batch and numbers their chunks, so each distinct chunk is looked
    up once a batch. Texts that hold an added token (as written, anywhere) go through
    the library as a whole."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.normalise, self.part = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        self.merge = self.library.model.tokenize
        # the library writes the bytes of other letters as characters of its own
        self.written = str.maketrans({c: self.part(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "\u00f7"})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the cache before; what is used of it moves over

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        mixed = functools.reduce(pc.or_, [pc.match_substring(texts, a) for a in self.added], pa.repeat(False, len(texts)))
        if not pc.any(mixed).as_py():
            return self.encode_plain(texts)
        ids, counts = self.encode_plain(pc.if_else(mixed, "", texts))
        whole = [np.array(self.library.encode(t, add_special_tokens=False).ids, dtype="<u4") for t in texts.filter(mixed).to_pylist()]
        at = np.flatnonzero(mixed.to_numpy(zero_copy_only=False))
        places = np.repeat(np.cumsum(counts)[at], [len(w) for w in whole])
        counts[at] = [len(w) for w in whole]
        return np.insert(ids, places, np.concatenate(whole)), counts

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` of texts without nulls and added tokens, chunk by chunk."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        chunks = split.flatten().dictionary_encode()
        found = self.lookup(chunks.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        chosen = chunks.indices.to_numpy()
        sizes = size[chosen]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        # from the place of each id among all ids to its place in ``flat``
        shift = (np.cumsum(size) - size)[chosen] - ends[:-1]
        ids = flat[np.repeat(shift, sizes) + np.arange(ends[-1])]
        per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy())))
        return ids, np.diff(ends[per_text])

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, chunks))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self.chunk_ids(chunks[k])
        return found

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a chunk by the caches, else by the library's steps."""
        ids = self.known.get(chunk)
        if ids is None:
            ids = self.older.get(chunk)
            if ids is None:
                ids = self.encode_chunk(chunk)
            if len(chunk) <= CACHED:
                self.known[chunk] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        """The library's steps one by one: normalise, part into pieces, merge. Where the first
        changes nothing, a piece has the ids of the chunk that consists of it."""
        if _SETTLED.fullmatch(chunk):
            pieces = _PIECES.findall(chunk)
            if len(pieces) > 1:
                return b"".join(map(self.chunk_ids, pieces))
            return array("I", [t.id for t in self.merge(chunk if chunk.isascii() else chunk.translate(self.written))]).tobytes()
        pieces = self.part(self.normalise(chunk))
        return array("I", [t.id for piece, _ in pieces for t in self.merge(piece)]).tobytes()


@functools.lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 end_id: int = END_ID, parts: int | None = None) -> None:
    """Encode every text (null: empty), append ``end_id`` and write blocks in ascending
    order of id (nulls first, rows of one id by a hash of their text).

    The texts are dealt by ranges of the id and sorted within, then encoded where
    they lie, so ids are shuffled never and texts once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunk_encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        part, block, size = TaskContext.get().partitionId(), 0, 0
        names, counts, held = [], [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            offsets, words = pack_runs(ids)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "doc_ids": names, "counts": counts, "n_ids": len(ids),
                                                "run_words": offsets, "words": words.astype("<u8").tobytes()}], schema=schema)

        for b in batches:
            ids, sizes = coder.encode_column(b.column(1))
            ends = np.cumsum(sizes)
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
            at = 0
            for name, to in zip(b.column(0).to_pylist(), ends.tolist()):
                names.append(name)
                held.append(ids[at:to])
                counts.append(to - at)
                size, at = size + to - at, to
                if size >= BLOCK_IDS:
                    yield close()
                    names, counts, held, block, size = [], [], [], block + 1, 0
        if names:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
                        ("n_ids", pa.int64()), ("run_words", pa.list_(pa.int32())), ("words", pa.binary())])
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of token files, with ``start``, the number of ids before each block
    in all files. The running sums are over one row a part, and over the blocks of
    one part."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = sizes.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "block", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    placed = starts.join(before, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    return files.join(placed, ["part", "block"])


def token_report(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: doc_id, start, n_tokens and CRC-32 of its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for b in batch.to_pylist():
            ids = unpack_runs(b["run_words"], np.frombuffer(b["words"], dtype="<u8"), b["n_ids"]).astype("<u4")
            at = 0
            for name, n in zip(b["doc_ids"], b["counts"]):
                rows.append({"doc_id": name, "start": b["start"] + at, "n_tokens": n, "ids_crc32": zlib.crc32(ids[at:at + n].tobytes())})
                at += n
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    blocks = read_blocks(spark, path).select("doc_ids", "counts", "n_ids", "run_words", "words", "start")
    return map_batches(blocks, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_report(docs: DataFrame, **how) -> DataFrame:
    """Write the token files of ``docs`` below the shared folder and report from them."""
    path = shared_path(docs.sparkSession, f"tokens/{uuid.uuid4().hex}")
    write_tokens(docs, path, **how)
    return token_report(docs.sparkSession, path)
