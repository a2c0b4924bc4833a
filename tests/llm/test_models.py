"""Vectors, toxicity, tokenizers, token files and the pipeline."""

import hashlib
import itertools
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from odd_rows import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarpit.llm import bpe, nn_descent, quality, token_files, toxicity

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_links(rows, threshold=0.9):
    """rows: (id, vector or None) -> [(id, n_links, component)]."""
    fine = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float)) for i in fine}
    near = {i: [j for j in fine if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in fine}
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(near.get(i, [])), min(ids) if ids else None))
    return out


def check_links(spark, rows, **how):
    got = nn_descent.link_vectors(spark.createDataFrame([(d, v, 0) for d, v in rows], VECTORS), **how).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute_links(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_links_of_groups_chains_and_copies(spark):
    rng = np.random.default_rng(4)
    f = lambda v: [float(x) for x in np.asarray(v, dtype=np.float32)]
    rows = [(i, f(rng.standard_normal(32))) for i in range(300)]
    for g in range(12):  # pairs to groups larger than a list, near and far
        centre = rng.standard_normal(32)
        rows += [(1000 * (g + 1) + i, f(centre + rng.standard_normal(32) * rng.choice([0.02, 0.2]))) for i in range(2 + g * 4)]
    x = rng.standard_normal(32)
    for i in range(10):  # a chain of steps, a cosine of 0.9 or so apart
        x = x / np.linalg.norm(x) + rng.standard_normal(32) * 0.07
        rows.append((50_000 + i, f(x)))
    rows += [(60_000 + i, rows[5][1]) for i in range(40)]  # copies
    check_links(spark, rows)


def test_links_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.1, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.01]), (11, [-1.0, 0.0]), (12, [3e38, 0.0])]
    check_links(spark, rows)
    assert nn_descent.link_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_on_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check_links(spark, rows)


def test_pairs_beside_a_large_group(spark, monkeypatch):
    """A third of the rows is one group, whose many links must not stand for those of pairs."""
    monkeypatch.setattr(nn_descent, "BUCKET", 4)  # as many bits as 32 times the rows have
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    group = unit(unit(rng.standard_normal(32)) + rng.standard_normal((600, 32)) * 0.03)
    x = unit(rng.standard_normal((600, 32)))
    u = rng.standard_normal(x.shape)
    u = unit(u - (u * x).sum(axis=1, keepdims=True) * x)
    vectors = np.concatenate([group, x, 0.902 * x + np.sqrt(1 - 0.902 ** 2) * u]).astype(np.float32)
    rows = nn_descent.link_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], VECTORS)).collect()
    by = {r.vec_id: r.component_id for r in rows}
    assert len(rows) == 1_800 and len({by[i] for i in range(600)}) == 1
    assert sum(by[i] == by[i + 600] for i in range(600, 1_200)) >= 0.995 * 600


def test_rounds_go_on_while_no_asked_node_has_a_link(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1_000, 32))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5_000, (x[7] * 2).tolist(), 0)], VECTORS)
    rounds, bars = [], nn_descent._bars
    monkeypatch.setattr(nn_descent, "AUDIT_QUERIES", 8)
    monkeypatch.setattr(nn_descent, "_bars", lambda lists, k: rounds.append(1) or bars(lists, k))
    nn_descent.link_vectors(rows, rounds=2)
    assert len(rounds) == 2


def test_tables_grow_with_bits():
    counts = [nn_descent._tables(nn_descent.TABLES, bits, 0.9) for bits in range(20)]
    assert counts[0] == nn_descent.TABLES and counts == sorted(counts) and counts[16] > 50


def test_noisy_channel_decoding(spark):
    words = "idiot moron loser stupid clown trash house garden little people every other the and of".split()
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(50)], "doc_id long, text string")
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    for seen, meant in {"1d10t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "l0ser": "loser", "s.t.u.p.i.d": "stupid", "cl0wn": "clown", "tr@sh": "trash", "lo$er": "loser"}.items():
        assert model.decode(seen) == meant
    reader = toxicity.Reader(model)
    assert "moron" in reader.words("you m o r o n there") and reader.words("little house, garden!") == {"little", "house", "garden"}
    assert reader.words("") == set()
    assert "idiot" in reader.words("an !diot") and "loser" in reader.words('a "|oser".') and "idiot" in reader.words("(!diot)")
    assert "little" in reader.words("(little") and "cunt" in reader.words("(unt")
    assert "idiot" in reader.words("!d!0t") and "tr@sh" not in reader.words("tr@sh!") and "stupid!" not in reader.words("stupid!!") and reader.read("$#!7") and reader.words("2024 $500 !!! (*)") <= {"", "2024", "$500", "c"}


def readings(token):
    """All letters a token may stand for with the cost of the channel, by its rules one
    run after another: as it is; a look-alike; a separator left out; a run shortened."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(token)]
    ways = []
    for c, n in runs:
        own = [(c * n, 0.0)] if c in toxicity.ALPHABET else []
        short = [(c * k, toxicity.RUN_COST) for k in (1, 2) if k < n] if own else []
        if n < 3:
            looks = [(x * n, n * toxicity.LOOK_COST) for x in toxicity.LOOKS.get(c, "")]
        else:
            looks = [(x, 2 * toxicity.LOOK_COST) for x in toxicity.LOOKS.get(c, "")]
        ways.append(own + short + looks + [("", toxicity.DROP_COST)] * (c in toxicity.DROPPED))
    for choice in itertools.product(*ways):
        yield "".join(x for x, _ in choice), sum(x for _, x in choice)


def test_viterbi_equals_all_readings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = toxicity.CharModel(toxicity.trigram_counts(docs))
    of = {c: k + 1 for k, c in enumerate(toxicity.ALPHABET)}

    def value(letters, cost):
        seq = [0, 0, *[of[c] for c in letters], 0]
        return sum(model.log[a, b, c] for a, b, c in zip(seq, seq[1:], seq[2:])) - cost

    rnd = random.Random(11)
    signs = "aeilostz" + "".join(toxicity.LOOKS) + ".-_*" + "%"
    for _ in range(400):
        token = "".join(rnd.choice(signs) * rnd.choice((1, 1, 1, 2, 3)) for _ in range(rnd.randrange(1, 7)))
        all_of = {}
        for letters, cost in readings(token):
            all_of[letters] = max(all_of.get(letters, -1e9), value(letters, cost))
        got = model.decode(token)
        if not all_of:
            assert got == ""
        else:
            assert all_of[got] == pytest.approx(max(all_of.values()), abs=1e-9), token


def test_toxicity_held_out_accuracy(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(10 ** 6, "what an 1d10t"), (10 ** 6 + 1, "m o r o n"), (10 ** 6 + 2, "the house and the garden")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(extra)
    rows = toxicity.toxicity_report(docs, labels).collect()
    assert len(rows) == 1000 + len(ODD) + 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth and r.doc_id > 100]
    wrong_clean = sum(p for t, p in held if t == 0)
    found = sum(p for t, p in held if t == 1)
    assert wrong_clean <= 0.02 * len(held) and found >= 0.5 * sum(t for t, _ in held)
    by = {r.doc_id: r.score for r in rows}
    assert by[10 ** 6] > 0.5 > by[10 ** 6 + 2] and by[10 ** 6 + 1] > by[10 ** 6 + 2]


def test_toxicity_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {round(r.score, 6) for r in toxicity.toxicity_report(odd, labels).collect()} == {0.5}
    assert toxicity.toxicity_report(none, labels).count() == 0


@pytest.fixture(scope="module")
def tik():
    r = bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=r.rank, special_tokens={})


def digests(tik, text):
    ids = tik.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_equals_the_library(small, odd, none, tik):
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text"))
    want = sorted((str(r.doc_id), *digests(tik, r.text)) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect()) == want
    assert bpe.round_trip(none).count() == 0
    ids = docs.filter("doc_id < 20").select("text", bpe.encode(F.col("text")).alias("ids")).select("text", "ids", bpe.decode(F.col("ids")).alias("back")).collect()
    assert all(r.ids == tik.encode_ordinary(r.text or "") and bytes(r.back) == (r.text or "").encode() for r in ids)


def test_bpe_trees_on_random_pieces(tik):
    import random
    rng, r = random.Random(9), bpe.ranks(public_tokenizers.path(bpe.VOCABULARY))
    pieces = ["".join(rng.choice("aaabcdeéñ🙂the ing") for _ in range(rng.randint(1, 60))).replace(" ", "") or "a" for _ in range(400)]
    pieces += ["ab" * 700, "a" * 5_000, "x"]
    want = [tik._encode_single_piece(p) for p in pieces]
    assert bpe.encode_pieces([p.encode() for p in pieces], r) == want
    assert [bpe.encode_long(p.encode(), r) for p in pieces if len(p) > 1] == [
        tik._encode_single_piece(p) if p.encode() not in r.rank else bpe.encode_long(p.encode(), r) for p in pieces if len(p) > 1]


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 50_000, 20_000), rng.integers(0, 2, 9_000), rng.geometric(0.01, 5_000), np.zeros(300, dtype=int), np.array([], dtype=int),
                np.array([2 ** 64 - 1, 0, 2 ** 60, 2 ** 60 - 1, 14 << 60, 1, 2 ** 63] * 9, dtype=np.uint64)):
        ids = ids.astype(np.uint64)
        assert (token_files.unpack(token_files.pack(ids), len(ids)) == ids).all()
        offsets, words = token_files.pack_runs(ids)
        assert (token_files.unpack_runs(offsets, words, len(ids)) == ids).all()
    assert len(token_files.pack(np.ones(600, dtype=np.uint64))) == 10  # 60 to a word


def test_added_tokens_equal_the_library():
    path = public_tokenizers.path(token_files.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = ["One text <|endoftext|> another", "no token here.", "x<|startoftext|>y<|endoftext|><|endoftext|>'s É", "<|ENDOFTEXT|> in capitals", "", "<|endoftext|>"]
    got = [np.frombuffer(ids, dtype="<u4").tolist() for ids in token_files.ChunkEncoder(path).encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49_407 in got[0] and 49_406 in got[2] and 49_407 not in got[3]


def test_a_batch_is_encoded_by_its_distinct_chunks(monkeypatch):
    path = public_tokenizers.path(token_files.VOCABULARY)
    coder, library, asked = token_files.ChunkEncoder(path), Tokenizer.from_file(path), []
    real = coder.lookup
    monkeypatch.setattr(coder, "lookup", lambda chunks: asked.append(list(chunks)) or real(chunks))
    draw = random.Random(4)
    signs = ["abzSLT ", "\u00df\u00e9\u00c0\u00ff\u00f7\u00d7\u00aa'.,!09 \t\n\x0b\x0c\x1c\x85\xa0", "\u0301\u200d\u3000\u6f22\u0130\u017f\u212a\x00\x7f\u0663", "it's 'S x''ll a.,b. "]
    texts = ["".join(draw.choice(draw.choice(signs)) for _ in range(draw.randrange(50))) for _ in range(500)]
    texts += [None, "", "the The  THE\nthe", "the <|endoftext|> the", *["the cat, the dog."] * 200]
    ids, counts = coder.encode_column(pa.array(texts))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0])) and {"the", "cat,", "dog."} <= set(asked[0])


def test_token_files_equal_the_library(spark, small, odd, none, scratch):
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    library.encode_special_tokens = True
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text"))
    path = f"{scratch}/tokens"
    token_files.write_tokens(docs, path, parts=5)
    rows = token_files.token_report(spark, path).orderBy("start").collect()
    assert len(rows) == docs.count()
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
    ids = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
    want = sorted((str(r.doc_id), len(x := ids(r.text)), zlib.crc32(x.tobytes())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert token_files.write_and_report(none).count() == 0


def test_pipeline_equals_brute_force(spark, small, tik):
    docs = [r for r in small.collect() if brute.quality(r.text, quality.BANDS, quality.CHUNK_BYTES, quality.MAX_BAD_CHUNKS)[-1]]
    docs.sort(key=lambda r: r.doc_id)
    parts = brute.classes([brute.fingerprint(r.text) for r in docs])
    docs = [r for i, r in enumerate(docs) if parts[i] == i]
    texts = {r.doc_id: brute.masked(r.text, brute.pii(r.text)) for r in docs}
    copies, _ = brute.mix([(r.doc_id, r.source, len(brute.WORD.findall(texts[r.doc_id]))) for r in docs])
    want = sorted((r.doc_id, *digests(tik, texts[r.doc_id])) for r in docs for _ in range(copies.get((r.source, brute.hash60(r.doc_id)), 0)))
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_pipeline_stages_on_odd_rows(spark, odd, none, scratch):
    for name, docs in (("odd", odd), ("none", none)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "").write.parquet(f"{scratch}/{name}{k}")
            docs = spark.read.parquet(f"{scratch}/{name}{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == odd.columns
