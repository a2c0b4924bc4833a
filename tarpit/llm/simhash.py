"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common value within r
bits of each. Every distinct fingerprint therefore emits all its variants
within half the maximum distance, the variants are shuffled, and fingerprints
that share one are verified and linked.

For 64 bits and distance 4 that is 2,081 variants a fingerprint, far more bytes
than the text it stands for, so the shuffle is made in two steps:

1. Each batch of fingerprints hashes its variants to ``log2(all variants) + 9``
   bits, sorts them and sends them, by their leading bits, as Elias-Fano coded
   blocks (a little over two bytes a variant). Each range of hashes reports to
   each batch which of its hashes another variant shares (one in a few hundred
   by chance). A range holds half a million variants, and more once blocks would
   get shorter than 256 variants (from some 10 million fingerprints on), so that
   the number of blocks stays in proportion to the variants.
2. The batches make these variants again, now in full, and they are joined on
   the whole 64 bits. This is exact: a variant that two fingerprints share has
   the same hash in both, so the first step loses none.

A variant has at most 2,081 fingerprints within its ball, so no key is hot:
copies of a text share one fingerprint and are folded before. Fingerprints in
one ball are linked to the least of them, which gives the same components as all
pairs would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.common import materialize
from .components import components
from .rows import bounded_batches, free_name, row_hash

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Fingerprints of a batch of the first step: 8.5 million variants of 8 bytes at radius 2.
BATCH = 4_096
#: Variants of a hash range, about, and least of a block (one batch's part of a range).
RANGE = 1 << 19
BLOCK = 256

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all shingles; 0 without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - shingle + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, seed=SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:n - 1])).tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops)]), dtype=np.uint8).reshape(n, 8)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a long with the same 64 bits."""
    def run(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t.as_py(), shingle) for t in texts]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long").asNondeterministic()(text)


def ball(radius: int) -> np.ndarray:
    """All 64-bit masks with at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)],
                    dtype=np.uint64)


def mix(x: np.ndarray, bits: int) -> np.ndarray:
    """The leading ``bits`` of a bijective 64-bit mix (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - bits)


def pack_sorted(values: np.ndarray, bits: int) -> bytes:
    """Elias-Fano code of sorted values of ``bits`` bits: the low bytes as they are
    (as many as make the code shortest; the first byte says how many), the rest
    as a unary bit string."""
    n = len(values)
    low = min(range(1 + bits // 8), key=lambda k: k * n + (n + (1 << max(0, bits - 8 * k))) // 8)
    unary = np.zeros((1 << (bits - 8 * low)) + n, dtype=np.uint8)
    unary[(values >> np.uint64(8 * low)).astype(np.int64) + np.arange(n)] = 1
    planes = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low]
    return bytes([low]) + planes.tobytes() + np.packbits(unary).tobytes()


def unpack_sorted(code: bytes, n: int) -> np.ndarray:
    low = code[0]
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :low] = np.frombuffer(code, dtype=np.uint8, count=low * n, offset=1).reshape(n, low)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, dtype=np.uint8, offset=1 + low * n)))[:n]
    return ((ones - np.arange(n)).astype(np.uint64) << np.uint64(8 * low)) | planes.view("<u8").ravel()


def at_most_twice(h: np.ndarray) -> np.ndarray:
    """Sorted values with every value at most twice: twice in one batch is a hit already."""
    keep = np.ones(len(h), dtype=bool)
    keep[2:] = h[2:] != h[:-2]
    return h[keep]


def shared_variants(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (fp, distinct) -> (variant, fp) for every variant within half of
    ``distance`` that, up to chance hits, another fingerprint has too."""
    if distance not in (0, 2, 4):
        raise ValueError("distance must be 0, 2 or 4: a ball of half of it is emitted, and one of radius 3 has 43,745 variants")
    masks = ball(distance // 2)
    n = prints.count()
    total = max(2, n * len(masks))
    per_range = max(RANGE, BLOCK * total // (BATCH * len(masks)))
    range_bits = max(0, math.ceil(math.log2(total / per_range)))
    in_range = max(8, math.ceil(math.log2(total)) + 9 - range_bits)
    batches = max(1, math.ceil(n / BATCH))
    spark = prints.sparkSession
    ranges = 1 << range_bits
    # a batch is named by the fingerprint's own hash, so a rerun makes the same batches
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches // 16)
    numbered = materialize(prints.select(F.pmod(F.xxhash64("fp"), F.lit(batches)).cast("int").alias("batch"), "fp")
                           .repartition(parts, "batch").sortWithinPartitions("batch"), "prints")

    def hashes(fps: np.ndarray) -> np.ndarray:
        return mix((fps[:, None] ^ masks[None, :]).ravel(), range_bits + in_range)

    def send(batch: int, fps: np.ndarray) -> pa.RecordBatch:
        h = hashes(fps)
        h.sort()
        h = at_most_twice(h)
        cuts = np.append(np.searchsorted(h, np.arange(ranges, dtype=np.uint64) << np.uint64(in_range)), len(h))
        rows = [(r, int(b - a), pack_sorted(h[a:b] & np.uint64((1 << in_range) - 1), in_range))
                for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        r, k, code = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array([batch] * len(r), pa.int32()),
                                           pa.array(k, pa.int32()), pa.array(code, pa.binary())],
                                          names=["range", "batch", "n", "code"])

    def by_batch(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """The fingerprints of each batch; rows arrive sorted by batch."""
        now, held = None, []
        for b in batches_in:
            ids, fps = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            edges = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                if ids[x] != now and held:
                    yield now, np.concatenate(held)
                    held = []
                now = int(ids[x])
                held.append(fps[x:y])
        if held:
            yield now, np.concatenate(held)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, fps in by_batch(it):
            yield send(batch, fps)

    def collide(key: tuple, group: pa.Table) -> pa.Table:
        r = np.uint64(key[0].as_py())
        found = []
        parts = [(b, unpack_sorted(c, k)) for b, k, c in zip(group.column("batch").to_pylist(), group.column("n").to_pylist(),
                                                             group.column("code").to_pylist())]
        every = np.sort(np.concatenate([h for _, h in parts]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        if len(twice):
            for b, h in parts:
                own = h[np.isin(h, twice)]
                if len(own):
                    found.append((b, ((r << np.uint64(in_range)) | np.unique(own)).tobytes()))
        return pa.table({"batch": pa.array([b for b, _ in found], pa.int32()),
                         "hits": pa.array([x for _, x in found], pa.binary())})

    bounded_batches(spark, rows=1 << 14)
    coded = numbered.mapInArrow(encode, "range int, batch int, n int, code binary")
    hits = coded.groupBy("range").applyInArrow(collide, "batch int, hits binary")

    def restore(key: tuple, own: pa.Table, reported: pa.Table) -> pa.Table:
        fps = own.column("fp").to_numpy().view(np.uint64)
        hot = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in reported.column("hits").to_pylist()] or
                                     [np.empty(0, dtype=np.uint64)]))
        v, f = [], []
        for at in range(0, len(fps) if len(hot) else 0, 512):
            part = fps[at:at + 512]
            h = hashes(part)
            i = np.searchsorted(hot, h)
            i[i == len(hot)] = 0
            which = np.flatnonzero(hot[i] == h)
            f.append(part[which // len(masks)])
            v.append(f[-1] ^ masks[which % len(masks)])
        join = lambda x: np.concatenate(x).view(np.int64) if x else np.empty(0, dtype=np.int64)
        return pa.table({"variant": join(v), "fp": join(f)})

    return numbered.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(restore, "variant long, fp long")


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``prints`` (fp, distinct) -> links (a, b): each fingerprint of a ball to the
    least of it, verified by the bits that differ."""
    least = F.min("fp").over(Window.partitionBy("variant"))  # a ball has 2,081 fingerprints at most
    return (shared_variants(prints, distance).withColumn("a", least).filter("fp <> a")
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= distance)
            .select("a", F.col("fp").alias("b")).distinct())


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key (hash of the whole row),
    fingerprint (16 hex digits) and component_id, the smallest doc_id of all
    documents reachable over fingerprints at most ``distance`` bits apart.

    Null texts count as empty; texts without a word have fingerprint zero and
    are linked like any other. Rows with a null id keep their own row; a class
    whose ids are all null has a null component_id.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), row_hash(docs).alias("row_key"),
                                   fingerprints(F.col(text_col), shingle).alias("fp")), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = components(fingerprint_links(classes.select("fp"), distance))
    member = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(member.join(least, "component").select("fp", "component", "component_id"), "members")
    return rows.join(named, "fp").select(
        "doc_id", "row_key", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, with one of each class: the
    smallest id, nulls last, and among rows of one id the one with the smallest
    hash of all its columns; of wholly equal rows one stays."""
    found = simhash_classes(docs, id_col, text_col, shingle, distance)
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row_key").alias("key"))
    first = found.groupBy("component").agg(F.min(rank).alias("r"))
    name, key = free_name(docs, "_keep_id"), free_name(docs, "_keep_key")
    keep = materialize(first.select(F.col("r.id").alias(name), F.col("r.key").alias(key)).distinct(), "keep")
    stays = docs.join(keep, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (row_hash(docs) == F.col(key)))
    return stays.dropDuplicates([name, key]).select(*[F.col(f"`{c}`") for c in docs.columns])
