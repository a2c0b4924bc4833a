"""Periodic runs, substring dedup and spelling variants against brute force and on odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
from brute import WORD
from odd_rows import ODD

from tarpit.llm import spelling, substrings, word_runs


def runs_by_search(words):
    """All runs, period by period."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((a, length, q) for (a, length), q in out.items())


def random_texts(rng, rounds):
    for _ in range(rounds):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k = rng.choice([1, 2, 3, 20])
            x = [b"%d" % rng.randrange(k) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 3)):
                turn = [b"%d" % rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 33]))]
                x += (turn * rng.randint(2, 9))[:rng.randint(1, 200)] + [b"%d" % rng.randrange(k) for _ in range(rng.randint(0, 5))]
            texts.append(x)
        yield texts


def test_runs_equal_a_search_by_period():
    for texts in random_texts(random.Random(4), 300):
        assert word_runs.find_runs(texts) == [runs_by_search(t) for t in texts]
    assert word_runs.find_runs([]) == []
    assert word_runs.find_runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    with pytest.raises(ValueError):
        word_runs.runs_of(np.arange(5), turns=2)


def test_transform_gives_exact_correlations():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, word_runs.PRIME, (3, 64)).astype(np.uint64)
    assert (word_runs.inverse(word_runs.transform(rows)) == rows).all()
    words = np.append(rng.integers(0, 3, 400), 10**6).astype(np.uint64)
    starts = np.arange(0, 300, 8)
    got = set(zip(*(x.tolist() for x in word_runs.zero_mismatches(words, starts, 8, 1))))
    assert got == {(s, d) for s in starts.tolist() for d in range(1, 16) if (words[s:s + 8] == words[s + d:s + d + 8]).all()}


def test_collapsed_texts_and_odd_rows(spark, odd, none):
    turn = " ".join(f"w{k}" for k in range(10))
    text = f"a b {turn} {turn} {turn} {turn} c d"
    row = word_runs.collapse_runs(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, runs int")).first()
    assert [tuple(r) for r in row.runs] == [(2, 40, 10)] and tuple(row.most) == (2, 40, 10)
    assert row.collapsed == f"a b {turn} c d"
    rows = word_runs.collapse_runs(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].collapsed == "word" and [tuple(r) for r in by_id[4].runs] == [(0, 30_000, 1)]
    assert by_id[2].collapsed == by_id[3].collapsed == by_id[7].collapsed == "" and by_id[2].most is None
    report = word_runs.run_report(odd)
    assert report.count() == len(ODD) and report.filter("runs_sha256 is null or collapsed_sha256 is null").isEmpty()
    assert word_runs.run_report(none).count() == 0


def repeats_by_windows(rows, window=20):
    """(doc_id, n_words, n_removed, digest) by a table of all windows."""
    rows = sorted(((d, WORD.findall(t or "")) for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for k, (_, words) in enumerate(rows):
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i:i + window]), (k, i))
    out = []
    for k, (d, words) in enumerate(rows):
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i:i + window])] != (k, i):
                gone[i:i + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def report_of(found):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found.collect()), key=str)


def test_repeats_equal_a_table_of_windows(spark, small):
    rng = random.Random(8)
    rows = []
    passages = [[f"p{rng.randrange(5)}" for _ in range(rng.randint(15, 60))] for _ in range(6)]
    for d in range(150):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 5):] if rng.random() < .5 else [f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 25))]
        rows.append((d * 3, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = repeats_by_windows(rows)
    assert sum(r[2] for r in want) > 1_000
    for sizes in ({}, {"batch_chars": 3_000, "range_chars": 5_000}):
        assert report_of(substrings.cut_repeats(docs, **sizes)) == want
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    assert report_of(substrings.cut_repeats(small)) == repeats_by_windows(rows)
    assert report_of(substrings.cut_repeats(small, window=6, batch_chars=50_000)) == repeats_by_windows(rows, 6)


def test_repeats_on_odd_rows(spark, odd, none):
    rows = substrings.cut_repeats(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    long = [r for r in rows if r.doc_id == 4][0]
    assert (long.n_words, long.n_removed, long.kept_text) == (30_000, 29_999, "word")
    assert [tuple(s) for s in long.spans] == [(1, 30_000)]
    # equal rows are one document, of rows without id the first has the smaller hash
    text = " ".join(f"w{k}" for k in range(30))
    rows = substrings.cut_repeats(spark.createDataFrame([(5, text, 1), (5, text, 2), (6, text, 3), (None, text, 4), (None, "x " + text, 5)],
                                                        "doc_id long, text string, batch int")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("5", 0), ("5", 0), ("6", 30), ("None", 30), ("None", 30)]
    assert substrings.cut_repeats(none).count() == 0
    assert substrings.repeat_report(none).count() == 0
    with pytest.raises(ValueError):
        substrings.cut_repeats(odd, window=7)


def test_window_hashes_and_packing():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 3, 5, 10, 20):
        h = substrings.window_hashes(words, width)
        assert len(h) == len(words) - width + 1
        own = [tuple(words[i:i + width].tolist()) for i in range(len(h))]
        assert len(set(own)) == len(set(zip(own, h.tolist()))) == len(set(h.tolist()))
    assert len(substrings.window_hashes(words[:4], 5)) == 0
    for values in (np.array([7], dtype=np.uint64), np.unique(rng.integers(0, 2**63, 1_000).astype(np.uint64) * np.uint64(2))):
        assert (substrings.unpack(*substrings.pack(values)) == values).all()


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups_by_pairs(counts, times=5):
    out = []
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    best = {w: min(xs, key=lambda x: (-counts[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if counts[b] >= times * counts[w]}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def test_spelling_groups_equal_all_pairs(spark):
    rng = random.Random(6)
    counts = {}
    while len(counts) < 600:
        word = "".join(rng.choice("abcéÀ") for _ in range(rng.randint(5, 8)))
        counts[word] = 5 ** rng.randint(1, 8) + rng.randint(0, 1)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = groups_by_pairs(counts)
    assert any(r[1] and r[2] != r[1] for r in want)
    for sizes in ({}, {"sample": 200, "cell": 10}):
        assert sorted(map(tuple, spelling.spelling_groups(words, **sizes).collect())) == want
    with pytest.raises(ValueError):
        spelling.spelling_groups(words, times=1)


def test_word_counts_and_typos(spark, odd, none, small):
    def typo(d, w):
        return spelling.planted_typo(d, w)
    want = {}
    rows = small.select("doc_id", "text").collect() + odd.select("doc_id", "text").collect()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = typo(d, re.sub("[A-Z]", lambda m: m.group().lower(), run))
            if len(w) >= 6:
                want[w] = want.get(w, 0) + 1
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text"))
    assert {r.word: r.n for r in spelling.word_counts(docs, rewrite=spelling.planted_typo).collect()} == want
    assert spelling.planted_typo(None, "abcdefg") == "abcdefg"
    assert spelling.spelling_report(none).count() == 0
    assert spelling.spelling_report(odd).count() >= 0
