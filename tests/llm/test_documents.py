"""Quality, licences, sharding, mixing, SimHash and personal data against brute force and on odd input."""

from collections import Counter

import brute
import pytest
from odd_rows import ODD

from tarpit.llm import licenses, mixing, pii, quality, sharding, simhash
from pyspark.sql import functions as F


def test_quality_equals_brute_force(spark, small, odd):
    docs = small.select("doc_id", "text").limit(60).union(odd.filter("length(text) < 1000 or text is null").select("doc_id", "text"))
    rows = docs.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute.quality(r.text, quality.BANDS, quality.CHUNK_BYTES, quality.MAX_BAD_CHUNKS)) for r in rows)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)
                 for r in quality.quality_report(docs).collect())
    assert got == want


def test_quality_bands_reject_repetition_and_noise(spark):
    import base64
    import random
    rng = random.Random(5)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(3_000))
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(400))
    same = " ".join(f"{k} all work and no play makes a dull text" for k in range(500))
    half = prose[:6_000] + " " + same
    rows = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(
        [(1, prose), (2, noise), (3, same), (4, half)], "doc_id long, text string")).collect()}
    assert rows[1].kept and not rows[2].kept and not rows[3].kept and not rows[4].kept
    assert not rows[2].base_failed
    assert rows[4].n_bad_chunks > 0.5 * rows[4].n_chunks


def test_keep_good_keeps_columns_and_rows(odd, none, small):
    assert quality.keep_good(odd).columns == odd.columns
    assert quality.keep_good(none).count() == 0
    good = {r.doc_id for r in quality.quality_report(small).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(small).collect()} == good
    assert len(good) > 150


def test_license_sequences_and_rules(spark, odd, none):
    mit = ("MIT License\n\nCopyright (c) 2020 A B\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           "files, to deal\nin the Software.\n\nThe above copyright notice and this permission notice shall be included in all\ncopies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
           "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.")
    apache = " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n"
    texts = {1: (mit, "mit-by,copyright,mit-grant,mit-notice,as-is-software", "MIT"), 2: (apache, "apache2-by,apache2-may-not", "Apache-2.0"),
             3: ("Some text. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "cc-by-nc,mit-by", "CC-BY-NC,MIT"),
             4: ("SPDX-License-Identifier: GPL-3.0-only", "spdx-gpl3", "GPL-3.0"), 5: ("The driver has a license", "", ""),
             6: ("This work is licensed under the GNU General Public License, version 3.", "gpl3-by", "GPL-3.0"),
             7: ("under the terms of the GNU General Public License as published by\nthe FSF, either version 3 of the License, or\n(at your option) any later version.", "gpl-or-later", "GPL-or-later")}
    rows = licenses.license_report(spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in rows} == {k: (s, x) for k, (_, s, x) in texts.items()}
    assert {r.n_unknown for r in rows if r.doc_id == 5} == {1}
    assert licenses.license_report(odd).count() == len(ODD)
    assert licenses.license_report(none).count() == 0


def test_license_headers_wrapped_as_published(spark):
    gpl = ("    This program is free software; you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n"
           "    the Free Software Foundation; either version 2 of the License, or\n    (at your option) any later version.\n\n"
           "    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           "    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n")
    lgpl = (" * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
            " * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n *\n"
            " * This library is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n"
            " * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU\n * Lesser General Public License for more details.\n")
    mpl = ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
           "file, You can obtain one at https://mozilla.org/MPL/2.0/.")
    lines = "The MIT License\nCopyright (c) 2020 A B\nThis file is part of C"
    texts = {1: (gpl, "gpl-or-later,gpl-warranty,gpl-by", "GPL-or-later"), 2: (lgpl, "lgpl-by,gpl-warranty,lgpl-by", "LGPL"), 3: (mpl, "mpl2-by", "MPL-2.0"),
             4: (lines, "mit-by,copyright", "MIT")}
    rows = licenses.license_report(spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in rows} == {k: (s, x) for k, (_, s, x) in texts.items()}


def test_creative_commons_notices_without_the_word_licence(spark):
    texts = {1: ("Available under CC BY-SA 4.0.", "cc-by-sa", "CC-BY-SA"), 2: ("Creative Commons Attribution 4.0 International", "cc-by", "CC-BY"),
             3: ("CC0 1.0 Universal", "cc0", "CC0-1.0"), 4: ("Photo: A B, CC-BY-NC 2.0", "cc-by-nc", "CC-BY-NC"),
             5: ("Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa", "CC-BY-NC-SA"), 6: ("No cue here.", "", "")}
    rows = licenses.license_report(spark.createDataFrame([(k, t) for k, (t, _, _) in texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.sentences, r.licenses) for r in rows} == {k: (s, x) for k, (_, s, x) in texts.items()}


def test_license_scan_equals_its_sql_on_hostile_texts(spark):
    import random
    import duckdb
    import pandas as pd
    rng = random.Random(2)
    parts = ["MIT License", "the MIT Licence ", "Copyright (c) 2020 A. B.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "\n", "\n\n", "\n * ",
             "\r\n", "; either version 2 of the License, or (at your option) any later version. ", "GNU General Public License", "GNU General Public\n# License", " v. 2.0. ",
             " Mozilla Public License", ";  ", "All rights reserved\n", "all rights\n reserved", "SPDX-License-Identifier: MIT", "\x01", "CC BY-SA 4.0", "CC0", "was issued",
             "\u212a licen\u017fe", "é", "cc_by", "as_is ", "İ", "\x0b", "\x85", "\u2028", "Creative Commons Attribution"]
    rows = [(k, "".join(rng.choice(parts) + rng.choice(["", "\n", " ", ". "]) for _ in range(rng.randint(1, 25)))) for k in range(1_500)] + [(None, None), (9_000, "")]
    got = sorted((str(r.doc_id), r.sentences, r.licenses, r.n_unknown) for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841  read by name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = sorted(("None" if r[0] is None else str(r[0]), *r[1:]) for r in duckdb.sql(licenses.LICENSE_SQL).fetchall())
    assert got == want and sum(r[2] != "" for r in got) > 1_000


def test_license_scan_is_linear_in_long_texts(spark):
    n = 1_000_000
    texts = [" " * n + "license", "license" + " \n" * (n // 2), "copyright (c) " * (n // 14), "license\n" + "-" * n, "license; " * (n // 9), 'license."' + '"' * n]
    rows = licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.sentences for r in rows} == {0: "", 1: "", 2: "copyright", 3: "", 4: "", 5: ""}


def shards_by_splitting(rows, limit):
    """Extendible hashing one bit at a time."""
    todo, done = [("", rows)], {}
    while todo:
        bits, own = todo.pop()
        if sum(n for _, n in own) <= limit or len({h for h, _ in own}) <= 1:
            done.update({h: bits for h, _ in own})
            continue
        for b in "01":
            part = [(h, n) for h, n in own if f"{h:060b}"[len(bits)] == b]
            if part:
                todo.append((bits + b, part))
    return done


@pytest.mark.parametrize("limit", [2_000, 20_000, 1 << 40])
def test_shards_equal_bitwise_splitting(small, odd, limit):
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = [(r.doc_id, brute.hash60(r.doc_id), len((r.text or "").encode())) for r in docs.collect()]
    want = shards_by_splitting([(h, n) for _, h, n in rows], limit)
    got = sharding.shard_report(docs, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == want[brute.hash60(r.doc_id)]
        assert r.shard_bytes == sum(n for _, h, n in rows if want[h] == r.shard)
        assert r.oversized == (r.shard_bytes > limit)


def test_shards_written_and_empty(spark, odd, none, scratch):
    assert sharding.shard_report(none).count() == 0
    sharding.write_shards(odd, f"{scratch}/s", 5_000)
    back = spark.read.parquet(f"{scratch}/s")
    assert back.count() == len(ODD)
    assert [c for c in back.columns if c != "_shard"] == odd.columns


def test_mix_equals_brute_force(small, odd):
    docs = small.select("doc_id", "text", "source").union(odd.select("doc_id", "text", "source"))
    rows = [(r.doc_id, r.source, len(brute.WORD.findall(r.text or ""))) for r in docs.collect()]
    copies, target = brute.mix(rows)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert r.copies == copies.get((r.source, brute.hash60(r.doc_id)), 0) and r.taken == r.copies * r.size <= 2 * r.size
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix_report(docs).collect())
    assert again == sorted((str(r.doc_id), r.taken) for r in got)


def test_mix_comes_near_targets_and_handles_empty(spark, none):
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
                                      F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 40)).alias("source"))
    sums = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 50 and r.target <= 2 * r.size for r in sums)
    assert sum(r.target for r in sums) == pytest.approx(1.5 * sum(r.size for r in sums))


def test_simhash_equals_brute_force(small, odd):
    docs = small.select("doc_id", "text").limit(120).union(odd.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute.fingerprint(t) for _, t in rows]
    parts = brute.classes(prints)
    least = {p: min((rows[i][0] for i in range(len(rows)) if parts[i] == p and rows[i][0] is not None), default=None) for p in parts}
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((rows[i][0], f"{prints[i]:016x}", least[parts[i]]) for i in range(len(rows))), key=key)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect()), key=key)
    assert got == want


def test_simhash_links_chains_and_distances(spark):
    import random
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(300)]
    prints = list(base)
    for b in base[:100]:  # near ones at each distance, and chains of four-bit steps
        for d in (1, 2, 3, 4, 5, 6):
            prints.append(b ^ sum(1 << k for k in rng.sample(range(64), d)))
    x = rng.getrandbits(64)
    for _ in range(12):
        x ^= sum(1 << k for k in rng.sample(range(64), 4))
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from tarpit.llm.components import components
    nodes = {r.node: r.component for r in components(simhash.fingerprint_links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    parts = brute.classes(prints)
    groups = {}
    for s, p in zip(signed, parts):
        groups.setdefault(p, set()).add(s)
    mine = {}
    for s in signed:
        mine.setdefault(nodes.get(s, s), set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_simhash_keeps_one_row_of_each_class(odd, none, small):
    assert simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text for r in rows]
    assert sum(t is not None and t.startswith("the cat") for t in texts) == 1  # the repeated row
    assert sum(not (t or "").strip() for t in texts) == 1  # texts without words are one class
    assert sorted(r.doc_id for r in rows if r.doc_id in (8, 9)) == [8]
    found = simhash.simhash_classes(small).select("component_id").distinct().count()
    assert simhash.keep_one(small).count() == found


HARD = [
    (101, "a@b.c_d@e.f +1 (222) 333-4444 5 a.b@c.d@e.f x@y a@b@c.d"),
    (102, "é🙂 1.2.3.4.5.6.7.8 0001.2.3.0255 256.1.1.1 1.2.3 4111-1111-1111-1111 4111 1111 1111 1111 1"),
    (103, "4012888888881881 " * 50 + "." * 50 + "1." * 200 + "+" * 50 + "9" * 3_000),
    (104, "x" * 30_000 + "@" + "y" * 30_000 + ".z " + "a.b@c-d.e" * 400),
    (105, "\ue000 a@b.c \ue001\ue000 marks 1.2.3.4"),
]


def test_pii_equals_brute_force(spark, small, odd):
    import hashlib
    docs = small.select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame(HARD, "doc_id long, text string"))
    key = lambda x: (x[0] is None, x[0] or 0, x[5])
    want = []
    for r in docs.collect():
        spans = brute.pii(r.text)
        want.append((r.doc_id, *[sum(k == kind for k, _, _ in spans) for kind in brute.PII], hashlib.sha256(brute.listed(spans).encode()).hexdigest()))
    rows = pii.pii_report(docs).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows), key=key) == sorted(want, key=key)
    for r in rows:  # the strict spans stay, in order
        found = r.spans.split(",") if r.spans else []
        assert len(found) >= r.n_email + r.n_ip + r.n_card + r.n_phone
        order = [(pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in found]
        assert order == sorted(order)


def test_pii_adds_dodged_spans_and_leaves_clean_text(spark, small):
    dodged = {
        201: ("write to john.doe [at] example [dot] com or", "john.doe [at] example [dot] com"),
        202: ("my mail is jo at site dot org please", "jo at site dot org"),
        203: ("call (437) 555-0689 today", "(437) 555-0689"),
        204: ("the host 10[.]1[.]2[.]3 is up", "10[.]1[.]2[.]3"),
        205: ("pay with card 4111.1111.1111.1111 now", "4111.1111.1111.1111"),
    }
    clean = {301: "look at the dot on the map at 12.5 percent", 302: "on 2024-01-02 10:00 we sold 1 234 567 pieces", 303: "isbn 978-3-16-148410-0 version 1 . 2 . 3 . 4 is out",
             304: "order 4539 1488 0343 6468 failed, see 4539148803436468"}
    docs = small.select("doc_id", "text").union(spark.createDataFrame([(k, t) for k, (t, _) in dodged.items()] + list(clean.items()), "doc_id long, text string"))
    rows = {r.doc_id: r.spans for r in pii.pii_report(docs).collect()}
    for k, (text, span) in dodged.items():
        at = text.index(span)
        assert [s.split(":", 1)[1] for s in rows[k].split(",")] == [f"{at}:{at + len(span)}"], (k, rows[k])
    assert all(rows[k] == "" for k in clean)
    assert all(rows[r.doc_id] == brute.listed(brute.pii(r.text)) for r in small.collect())


def test_pii_mask(odd, none, small):
    assert pii.mask(none).count() == 0 and pii.mask(odd).columns == odd.columns
    rows = {r.doc_id: r for r in pii.mask(small).collect()}
    for r in small.collect():
        assert rows[r.doc_id].text == brute.masked(r.text, brute.pii(r.text))
        assert rows[r.doc_id].source == r.source
    texts = [r.text for r in pii.mask(odd).collect()]
    assert len(texts) == len(ODD) and sum("<EMAIL>" in (t or "") and "<PHONE>" in t for t in texts) == 1


def test_pii_takes_many_spans_in_one_text(spark):
    n = 40_000
    unit = "call (437) 555-0689 now "
    docs = spark.createDataFrame([(1, unit * n), (2, "write to jo@mail.example.com or 1.2.3.4. " * 5_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    assert rows[1].spans == ",".join(f"phone:{k * len(unit) + 5}:{k * len(unit) + 19}" for k in range(n))
    assert rows[2].n_email == rows[2].n_ip == 5_000
    texts = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert texts == {1: "call <PHONE> now " * n, 2: "write to <EMAIL> or <IP>. " * 5_000}


def test_pii_runs_without_python(small):
    plan = pii.pii_report(small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_as_an_operator_names_its_own(spark, odd, scratch):
    names = ["_keep_id", "_KEEP_KEY", "_mix_source", "_mix_cuts", "_mix_cut", "_shard", "_bucket0", "_depth0", "_quality"]
    rows = odd.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns and kept.count() == simhash.keep_one(odd).count()
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mixing.mix(odd).collect())
    assert quality.keep_good(rows).columns == rows.columns
    sharding.write_shards(rows, f"{scratch}/named", 5_000)
    back = spark.read.parquet(f"{scratch}/named")
    assert set(back.columns) == {*rows.columns, "_shard_"}
    key = lambda r: tuple(str(r[c]) for c in rows.columns)
    assert sorted(map(key, back.collect())) == sorted(map(key, rows.collect()))
