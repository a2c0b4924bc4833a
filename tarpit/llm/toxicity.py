"""Toxicity of texts, read through a noisy channel.

People write around word filters: ``1d10t``, ``s t u p i d``, ``looooser``. A
suspicious token is a lattice: every character may stand for itself or for the
letters it resembles, separators inside may be dropped and a run of one letter may
be one or two. Punctuation that resembles letters (``!``, ``|``, ``(``) is read both ways
at the edges of a token: cut off, and as a part of it. Viterbi decoding finds the likeliest letters under a character
trigram model times the channel's costs; the model is counted over all documents.

The score is a logistic regression on words and character 4- to 6-grams of the plain
and the restored words. All of them are counted by hash; those with a promising hash
are counted by themselves, and the ones that tell the classes apart best are kept
(``FEATURES``). The regression is fitted on a bounded sample of labelled documents
(``TRAIN_DOCS``, those of least hash; equal texts once). To score, an Aho-Corasick
automaton of the features runs over the words of a text.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, functions as F

from ..operators.common import materialize
from .rows import bounded_batches

TRAIN_DOCS = 40_000
FEATURES = 4_096
BINS = 1 << 19
POSITIVE_WEIGHT = 2.0
CACHE = 500_000

# The alphabet of the character model and what characters resemble.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ"
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
         "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "*": "aeiou", "#": "h"}
DROPPED = set(".-_*~'`^/\\")
#: Costs of the channel in nats: a letter by a look-alike, a dropped separator, a shortened run.
LOOK_COST, DROP_COST, RUN_COST = 0.7, 0.7, 0.7

SIDE = len(ALPHABET) + 1  # 0: anything that ends a word
_CODE = np.zeros(0x110000, dtype=np.uint8)
for _k, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _k + 1
INDEX = {c: k + 1 for k, c in enumerate(ALPHABET)}

_EDGE = ".,;:!?\"'()[]{}|%&#*"
#: Punctuation at an edge that is never a letter.
_BARE_EDGE = "".join(c for c in _EDGE if c not in LOOKS)
_SIGNS = [c for c in _EDGE if c in LOOKS]
_PLAIN = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1\1")
_SPACED = re.compile(r"(?<!\S)(?:\S[ .*_-]{1,2}){2,}\S(?![^\s.,;:!?])")


class CharModel:
    """Log probabilities of a letter after two others, mixed with shorter contexts."""

    def __init__(self, trigrams: np.ndarray) -> None:
        three = trigrams.reshape(SIDE, SIDE, SIDE).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIDE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.log = np.log(p3)

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token; "" if none is found."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        k = 0
        while k < len(token):
            c, run = token[k], 1
            while k + run < len(token) and token[k + run] == c:
                run += 1
            k += run
            options = [(s, 0.0) for s in (c * run,) if c in INDEX]
            if c in INDEX and run > 1:
                options += [(c, RUN_COST)] + ([(c + c, RUN_COST)] if run > 2 else [])
            for look in LOOKS.get(c, ""):
                options += [(look * run, LOOK_COST * run)] if run < 3 else [(look, LOOK_COST * 2)]
            if c in DROPPED:
                options.append(("", DROP_COST))
            if not options:
                return ""
            best: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in states.items():
                for letters, cost in options:
                    x, y, value = a, b, score - cost
                    for letter in letters:
                        z = INDEX[letter]
                        value += self.log[x, y, z]
                        x, y = y, z
                    if (x, y) not in best or best[x, y][0] < value:
                        best[x, y] = value, text + letters
            states = best
        return max((score + self.log[a, b, 0], text) for (a, b), (score, text) in states.items())[1]


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams (others end a word) over all texts; one number for
    each of ``SIDE`` cubed, whatever the input."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIDE ** 3, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                text = (t.as_py() or "").lower()
                if text:
                    points = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    s = _CODE[points].astype(np.int32)
                    # not of two ends in a row
                    gram = (s[:-2] * SIDE + s[1:-1]) * SIDE + s[2:]
                    total += np.bincount(gram[(s[1:-1] > 0) | (s[2:] > 0)], minlength=SIDE ** 3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    bounded_batches(docs.sparkSession)
    out = np.zeros(SIDE ** 3, dtype=np.int64)
    sums = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


class Reader:
    """Words of a text, plain and restored."""

    def __init__(self, model: CharModel) -> None:
        self.model, self.known = model, {}

    def words(self, text: str) -> set[str]:
        if len(self.known) > CACHE:
            self.known.clear()
        lower, known = text.lower(), self.known
        tokens = set(lower.split())
        out = {t.strip(_EDGE) for t in tokens}
        runs = _RUN.search(lower) is not None
        odd = [w for w in out if not w.isalpha() or runs and _RUN.search(w)]
        signed = {t for c in _SIGNS if c in lower for t in tokens if c in t}
        odd += {x for t in signed for x in self.with_edges(t)} - out
        for core in odd:
            if (found := known.get(core)) is None:
                found = self.read(core)
                if len(core) <= 64:
                    known[core] = found
            out.update(found)
            if core not in found:
                out.discard(core)
        for m in _SPACED.finditer(lower):
            joined = re.sub(r"[\s.*_-]", "", m.group())
            out.update((joined, *self.read(joined)))
        return out

    @staticmethod
    def with_edges(token: str) -> set[str]:
        """A token with the signs at its ends that may be letters, an opening bracket
        read both ways; ``!`` after a plain word ends a sentence."""
        core = token.strip(_BARE_EDGE)
        if core.strip(_EDGE).isalpha():
            core = core.rstrip(_BARE_EDGE + "!")
        return {core, core.lstrip("(")}

    def read(self, core: str) -> tuple[str, ...]:
        """What a token that isn't just letters, or has a run of one, may stand for."""
        core = re.sub(r"\${3,}$", "", core)
        if core.isalpha():
            return (core, self.model.decode(core)) if _RUN.search(core) else (core,)
        parts = _PLAIN.findall(core)
        if any(c in INDEX for c in core):
            hidden = any(c in LOOKS or c in DROPPED for c in core)
        else:  # no plain letter: not numbers and amounts, but signs of two kinds
            hidden = len({c for c in core if c in LOOKS and not c.isdigit()}) > 1
        if not hidden:
            return tuple(parts)
        # plain words joined by punctuation are words; look-alikes inside are read as letters
        return (*parts, *filter(None, (self.model.decode(core),)))


def grams_of(word: str) -> set[str]:
    """Features of a word: itself and its 4- to 6-grams, ends marked."""
    raw = f"^{word}$"
    n = len(raw)
    return {raw, *[raw[i:i + 4] for i in range(n - 3)], *[raw[i:i + 5] for i in range(n - 4)], *[raw[i:i + 6] for i in range(n - 5)]}


def bin_of(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BINS


class Tally:
    """Documents of each class by feature: by hash of all features, or by the features
    whose hash is among ``bins``."""

    def __init__(self, counts: np.ndarray, bins: set[int] | None = None) -> None:
        self.reader, self.bins, self.known = Reader(CharModel(counts)), bins, {}

    def _cached(self, word: str, make):
        if (found := self.known.get(word)) is None:
            found = make(word)
            if len(word) <= 64:
                self.known[word] = found
        return found

    def hashes(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        make = lambda w: array("i", {bin_of(g) for g in grams_of(w)}).tobytes()
        return np.unique(np.frombuffer(b"".join([self._cached(w, make) for w in self.reader.words(text)]), dtype=np.int32))

    def features(self, text: str) -> set[str]:
        if len(self.known) > CACHE:
            self.known.clear()
        make = lambda w: tuple(g for g in grams_of(w) if bin_of(g) in self.bins)
        return {g for w in self.reader.words(text) for g in self._cached(w, make)}


class Finder:
    """The chosen features in a text."""

    def __init__(self, counts: np.ndarray, features) -> None:
        self.reader, self.automaton = Reader(CharModel(counts)), ahocorasick.Automaton()
        for f in features:
            self.automaton.add_word(f, f)
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[str]:
        if self.empty:
            return set()
        return {f for _, f in self.automaton.iter("".join([f"^{w}$" for w in self.reader.words(text)]))}


class ToxicityModel:
    """Character counts, weights by feature and intercept; picklable, of bounded size."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], intercept: float) -> None:
        self.counts, self.weights, self.intercept = counts.astype(np.float32), weights, intercept

    def scorer(self):
        finder, w = Finder(self.counts, self.weights), self.weights

        def score(text: str | None) -> float:
            z = self.intercept + math.fsum(w[f] for f in finder.of(text or ""))
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          train_docs: int = TRAIN_DOCS, n_features: int = FEATURES) -> ToxicityModel:
    """Fit on at most ``train_docs`` labelled documents (a document with several labels is
    toxic if one says so); the character model is counted over all of ``docs``."""
    counts = trigram_counts(docs, text_col)
    picked = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
              .agg(F.max(label_col).cast("double").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(train_docs))
    picked = materialize(picked, "picked")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(picked), "_id")
    # train_docs rows at most; repeated ids have a row each
    sample = materialize(texts.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("label").alias("label")), "sample")
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], int(totals["toxic"] or 0)
    if not 0 < toxic < n:
        return ToxicityModel(counts, {}, math.log((toxic + 1) / (n - toxic + 1)))

    def by_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, total = Tally(counts), np.zeros((2, BINS), dtype=np.int64)
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[int(label), tally.hashes(text)] += 1
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[1, some]), pa.array(total[0, some])], names=["f", "yes", "no"])

    clean = n - toxic

    def best(counted: DataFrame, most: int) -> list:
        rate = (F.col("yes") + F.col("no") + 1) / n
        z = (F.col("yes") / toxic - F.col("no") / clean) / F.sqrt(rate * (1 / toxic + 1 / clean))
        sums = counted.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter("yes >= 2")
        return [r["f"] for r in sums.withColumn("z", z).filter("z > 2").orderBy(F.desc("z"), "f").limit(most).collect()]

    labelled = sample.select("text", "label")
    bins = best(labelled.mapInArrow(by_hash, "f int, yes long, no long"), 4 * n_features)

    def by_feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, total = Tally(counts, set(bins)), {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for f in tally.features(text):
                    total.setdefault(f, [0, 0])[int(label)] += 1
        rows = list(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in rows], pa.string()), pa.array([c[1] for _, c in rows], pa.int64()),
                                          pa.array([c[0] for _, c in rows], pa.int64())], names=["f", "yes", "no"])

    chosen = best(labelled.mapInArrow(by_feature, "f string, yes long, no long"), n_features) if bins else []
    if not chosen:
        return ToxicityModel(counts, {}, math.log(toxic / clean))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(counts, chosen)
        for b in batches:
            found = [sorted(finder.of(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), b.column(1)], names=["f", "label"])

    vocabulary = CountVectorizerModel.from_vocabulary(chosen, inputCol="f", outputCol="features")
    vocabulary = vocabulary.setBinary(True)
    marked = materialize(labelled.mapInArrow(mark, "f array<string>, label double").withColumn(
        "weight", F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(1.0)).coalesce(8), "marked")
    fitted = LogisticRegression(weightCol="weight", regParam=2e-4, maxIter=40, standardization=False).fit(vocabulary.transform(marked))
    return ToxicityModel(counts, dict(zip(chosen, map(float, fitted.coefficients.toArray()))), float(fitted.intercept))


def score_docs(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id and score (0 to 1); null and empty texts get the
    score of a text without features."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIDE^3 counts and n_features weights

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = shared.value.scorer()
        for part in texts:
            yield pa.array([score(t.as_py()) for t in part], pa.float64())

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.select(F.col(id_col).alias("doc_id"), F.arrow_udf(run, "double").asNondeterministic()(F.col(f"`{text_col}`")).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Train on the labels that are not held out and score every row of ``docs``:
    doc_id, held_out, score, predicted."""
    model = train(docs, labels.filter(~held_out()), **how)
    return score_docs(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
