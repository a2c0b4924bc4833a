"""Quality rules: zstandard compression bands over whole texts and fixed chunks.

A text that compresses far better than prose of its length is repetitive; one
that hardly compresses is noise (random bytes, encoded data). The ratio of a
natural text falls with its length, because a compressor needs input before it
finds matches, so each band has its own lower and upper limit for texts of a
certain length. The same limits are applied to fixed chunks: a long text whose
chunks mostly fall outside their band is rejected even if the whole text looks
ordinary (half noise and half repetition average out over the whole).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .rows import bounded_batches, free_name

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


class Band(NamedTuple):
    """Limits of compressed / raw bytes for inputs of at least ``least_bytes``."""

    least_bytes: int
    low: float
    high: float


#: Ratios of prose by length; the frame of a zstandard stream costs a few bytes,
#: so the upper limit of short inputs is above 1. Below the first band nothing
#: can be said and nothing is rejected.
BANDS = (
    Band(100, 0.32, 1.00),
    Band(400, 0.28, 0.88),
    Band(1_000, 0.24, 0.74),
    Band(4_000, 0.20, 0.66),
    Band(16_000, 0.17, 0.62),
    Band(64_000, 0.14, 0.60),
)
CHUNK_BYTES = 4_096
#: Share of chunks that may lie outside their band.
MAX_BAD_CHUNKS = 0.5
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "zstd_ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean")


def outside(raw: int, packed: int, bands: tuple[Band, ...]) -> bool:
    """Whether the ratio lies outside the limits for this length."""
    fit = [b for b in bands if raw >= b.least_bytes]
    return bool(fit) and not fit[-1].low <= packed / raw <= fit[-1].high


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    v = len(seen)
    pair = ids[:-1] * v + ids[1:]
    if v >= 1 << 20:  # the triple would not fit 63 bits: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    key = pair[:-1] * v + ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= repeated
    return int(covered.sum())


def measure(text: str | None, packer: zstandard.ZstdCompressor, bands=BANDS, chunk_bytes=CHUNK_BYTES,
            max_bad_chunks=MAX_BAD_CHUNKS) -> tuple:
    """The columns of ``SCHEMA`` for one text (null counts as empty)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() parts at ASCII white space exactly
    chars = len(text) - sum(map(text.count, WHITE))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeats = repeat_words(words)
    packed = len(packer.compress(raw)) if raw else 0
    chunks = bad = 0
    if len(raw) > chunk_bytes:
        for at in range(0, len(raw), chunk_bytes):
            part = raw[at:at + chunk_bytes]
            if len(part) >= bands[0].least_bytes:
                chunks += 1
                bad += outside(len(part), len(packer.compress(part)), bands)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    rejected = outside(len(raw), packed, bands) or bad > max_bad_chunks * chunks
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats,
            packed / len(raw) if raw else 0.0, chunks, bad, failed, not failed and not rejected)


def compression_rules(text: Column, bands=BANDS, chunk_bytes: int = CHUNK_BYTES,
                      max_bad_chunks: float = MAX_BAD_CHUNKS) -> Column:
    """Struct of ``SCHEMA`` for a text column; only the text goes to Python.

    A null text counts as empty and an empty text has 0 words, ratio 0 and fails
    the base rules. Marked non-deterministic only so that Spark does not run it
    once for a filter and again for the output.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def run(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        found = [measure(t.as_py(), packer, bands, chunk_bytes, max_bad_chunks) for t in texts]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), types)] if found
                                          else [pa.array([], k) for k in types], names=names)

    # typed here: annotations are strings in this module and the kind of UDF is read from them
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SCHEMA).asNondeterministic()(text)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: id and the measures; other columns are left out."""
    bounded_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).alias("doc_id"), compression_rules(F.col(text_col), **limits).alias("q"))
            .select("doc_id", "q.*"))


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that pass; no shuffle."""
    bounded_batches(docs.sparkSession)
    mark = free_name(docs, "_quality")
    return (docs.withColumn(mark, compression_rules(F.col(text_col), **limits))
            .filter(F.col(mark).getField("kept")).drop(mark))
