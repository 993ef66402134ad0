"""The ten operators against brute force on small fixtures with nulls, empty and long texts, ties and clashing columns."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestream.llm import embedding_dedup, license_scan, mixing, ngram_join, packing, quality_rules, sharding, token_counts, toxicity, url_filter

DOCS = "doc_id long, text string, source string, lang string, n_chars long, n_words long, kept boolean, shard int, size long, token long, component string"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = " ".join(rng.choices(words, k=80))
    texts = [None, "", "  ", "one", "one", "a b c", "Tab\there  two  spaces \n", base, base, base.upper(), base + " extra", base.replace("w1 ", "zz "), "x " * 3000, "naïve “quotes” 日本語 <|endoftext|> end", "last.\n\nline, ok."]
    texts += [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(40)] + [" ".join(rng.choices(words[:40], k=2500))]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else f"s{i % 3}", "en", 0, 1, True, 1, 2, 3, "c") for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_quality(docs, empty):
    got = by_id(quality_rules.judge(docs))
    for i, t in corpus():
        w = (t or "").split()
        windows = {}
        for p in range(len(w) - 4):
            windows.setdefault(tuple(w[p : p + 5]), []).append(p)
        covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 10 or 5 * len(covered) > len(w))
    assert quality_rules.judge(empty).count() == 0


def test_join(docs, empty, spark):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[p : p + 4]) for p in range(len(w) - 3)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in corpus()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(ngram_join.join(docs))
    assert {i: (got[i].n_shingles, got[i].component_id) for i in sets} == {i: (len(sets[i]), root[i]) for i in sets}
    assert ngram_join.join(empty).count() == 0


def test_prefix_shares_as_many_tokens_as_promised():
    rng = np.random.default_rng(1)
    hot, counts = np.arange(0, 400, 3), rng.integers(1, 500, 134)
    for _ in range(300):
        a = rng.choice(400, rng.integers(1, 60), replace=False)
        b = np.unique(np.append(a[rng.random(len(a)) > 0.06], rng.choice(400, 2)))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            (m, x), (n, y) = (ngram_join.adaptive_prefix(s.astype(np.int64), hot, counts, 85, 100) for s in (a, b))
            assert len(np.intersect1d(x, y)) >= min(m, n)


def test_tokens(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path))
    assert {i: (got[i].n_bytes, got[i].n_tokens) for i, _ in corpus()} == {i: (len((t or "").encode()), len(sp.encode(t or ""))) for i, t in corpus()}
    assert token_counts.token_counts(empty, path).count() == 0


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, rows = Tokenizer.from_file(path), packing.pack(docs, path).collect()
    for i, t in corpus():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        for k, r in enumerate(sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length])))
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(empty, path).count() == 0


def test_evolution_keeps_every_piece():
    rng = random.Random(5)
    sizes = [rng.randint(200, 1500) for _ in range(150)]
    first = packing.evolve(sizes, [], 2048, 1)
    again = packing.evolve(sizes, [first], 2048, 2)
    assert max(again) <= max(first)
    for of in (first, again):
        fill = {}
        for s, k in zip(sizes, of, strict=True):
            fill[k] = fill.get(k, 0) + s
        assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(sizes)


def test_sharding(docs, empty):
    rows = sharding.shard(docs.where("doc_id > 14 AND doc_id < 55").union(docs.where("doc_id > 14 AND doc_id < 55")), 4).collect()
    assert len(rows) == 80
    load = {}
    for r in rows:
        load.setdefault(r.shard, []).append(r)
    assert sorted(load) == [0, 1, 2, 3] and all(sorted(x.slot for x in v) == list(range(len(v))) for v in load.values())
    sums = [sum(x.size for x in v) for v in load.values()]
    assert max(sums) - min(sums) < 0.05 * sum(sums)
    assert sharding.shard(empty).count() == 0


def test_sharding_keeps_groups_up_to_a_share_whole(spark):
    """Of 8 shards of 100 texts each: groups of an eighth to nine tenths of a share, and one of two and a half shares."""
    texts = [f"group {n:03d} of equal texts" for n in (13, 20, 50, 90) for _ in range(n)] + ["the biggest group, equal"[:24]] * 250
    texts += [f"single text {i:06d} stands."[:24] for i in range(800 - len(texts))]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8).collect()
    of, load = {}, {}
    for r in got:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
        load[r.shard] = load.get(r.shard, 0) + r.size
    assert len(got) == 800 and len(load) == 8
    assert all(len(k) == 1 for t, k in of.items() if not t.startswith("the biggest")) and len(of["the biggest group, equal"]) == 3
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 8


def test_best_fit_tree():
    sizes = sorted([random.Random(1).randint(1, 50) for _ in range(200)], reverse=True)
    bins, n = sharding.best_fit_decreasing(sizes, 60)
    room, of = [], []
    for s in sizes:
        fit = sorted((r, k) for k, r in enumerate(room) if r >= s)
        k = fit[0][1] if fit else len(room)
        if not fit:
            room.append(60)
        room[k] -= s
        of.append(k)
    assert (bins, n) == (of, len(room))


def test_mixing(docs, empty):
    got = by_id(mixing.plan(docs))
    size = {i: len((t or "").split()) for i, t in corpus()}
    assert {i: got[i]["size"] for i in size} == size
    targets = {(r.source_size, r.target) for r in got.values()}
    assert abs(sum(t for _, t in targets) - sum(size.values())) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets)
    assert all(r.copies <= 3 for r in got.values()) and mixing.mix(docs, ["doc_id", "text"]).count() == sum(r.copies for r in got.values())
    assert mixing.plan(empty).count() == 0


def test_urls(spark):
    rows = [(1, "http://A.com/x"), (2, "https://example.com/en/1"), (3, "http://www.example.com/en/2?q"), (4, "http://x.net/es/"), (5, None), (6, "nothing"), (7, "http://com"), (8, "http://n.org/a/b#c")]
    got = by_id(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")), "page_id")
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("a.com", "/x", "com/", "allow"), 2: ("example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 4: ("x.net", "/es/", "net/es/", "block"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 8: ("n.org", "/a/b", None, "allow"),
    }


def test_url_templates_learn_from_labels(spark):
    pages = spark.createDataFrame([(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}") for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "page_id long, blocked int")
    got = by_id(url_filter.judge(pages, labels), "page_id")
    assert all(r.verdict == ("block" if k % 2 else "allow") for k, r in got.items())


def test_urls_pool_similar_branches_at_any_depth(spark):
    """Forty branches with one blocked page each are too few alone but alike; a branch that differs keeps apart, deep down too."""
    deep = "a/b/c/d/e/f/g/h/i"
    urls = [*(f"http://h.org/{deep}/spam{chr(97 + i % 26)}{chr(97 + i // 26)}/{k}" for i in range(40) for k in range(2)), *(f"http://h.org/{deep}/fine/{k}" for k in range(19)), *(f"http://h.org/{deep}/other/{k}" for k in range(5))]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, n int, template string")
    labels = spark.createDataFrame([*((2 * i, 1) for i in range(40)), *((80 + k, 0) for k in range(19))], "page_id long, blocked int")
    got = by_id(url_filter.judge(pages, labels), "page_id")
    assert {("spam" in u, got[i].verdict) for i, u in enumerate(urls)} == {(True, "block"), (False, "allow")}
    assert url_filter.judge(pages.limit(0), labels).count() == 0 and url_filter.judge(pages.union(pages), labels).count() == 2 * len(urls)


@pytest.mark.parametrize("n", (10, 100, 10_000))
def test_urls_without_labels_are_not_judged_by_their_siblings(spark, n):
    """Explicit rules block /es/ and /fr/ of a .net host; nothing is known of /en/, of /de/ or of many further branches."""
    parts = ["es", "fr", "en", "de", *(f"part{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))]
    pages = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.net/"), F.get(F.array(*map(F.lit, parts)), (F.col("id") % F.when(F.col("id") % 2 == 0, 4).otherwise(len(parts))).cast("int")), F.lit("/"), F.col("id")).alias("url"))
    got = {(r["branch"], r["verdict"]) for r in url_filter.judge(pages).select(F.split("path", "/")[1].alias("branch"), "verdict").distinct().collect()}
    assert {b for b, v in got if v == "block"} <= {"es", "fr"} and {v for b, v in got if b in ("es", "fr")} == {"block"}


def test_licenses(spark):
    rows = [(1, "Hi.\nLicensed under the Apache License, Version 2.0.\n"), (2, "This work is licensed under the GNU General Public License, version 3. Or, at your option, any later version."), (3, None), (4, "no license here")]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[k].license for k in (1, 2, 3, 4)] == ["Apache-2.0", "GPL-3.0-or-later", None, None]


LICENCES = (
    ("MIT", "// SPDX-License-Identifier: MIT\nint main() {}"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */"),
    ("Apache-2.0", 'Copyright 2020 A\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'),
    ("Apache-2.0", "# This is distributed under the terms of the Apache\n# License, v. 2.0\n# see below"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal in\nthe Software\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY'),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version."),
    ("GPL-3.0", "The tool is released under the GNU General Public License,\nversion 3."),
    ("GPL-2.0", "It is distributed under the GNU GPL v2"),
    ("GPL", "This program is free software under the\nGNU General Public License."),
    ("LGPL", "You can redistribute it and/or modify it under the terms of the GNU Lesser\nGeneral Public License"),
    ("BSD-3-Clause", "All rights reserved.\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted:\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Texts are licensed under a Creative Commons Attribution-NonCommercial 4.0\nInternational License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed"),
    ("Proprietary", "Copyright A. All rights\nreserved."),
    (None, "This work is licensed under a Creative Commons Attribution 3.0 License"),
    (None, "It is not licensed under the MIT License."),
)


def test_licenses_of_canonical_texts(spark):
    got = by_id(license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(LICENCES)], "doc_id long, text string")))
    assert [(got[i].license, t) for i, (_, t) in enumerate(LICENCES)] == list(LICENCES)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    vectors = [*base, *(base[:30] + 0.16 * rng.standard_normal((30, 16)))]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)] + [(90, None, 1), (91, [0.0] * 16, 1), (92, [float("nan")] * 16, 1), (93, rows_copy := [float(np.float32(x)) for x in base[1]], 1), (94, rows_copy, None)]
    got = by_id(embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")), "vec_id")
    true = {i: set() for i, _, _ in rows}
    for i, v, a in rows:
        for j, u, b in rows:
            if i != j and a is not None and a == b and v and u and np.isfinite(v).all() and np.isfinite(u).all() and any(v) and any(u):
                x, y = np.array(v), np.array(u)
                if x @ y >= 0.93 * np.sqrt(x @ x) * np.sqrt(y @ y):
                    true[i].add(j)
    assert {i: got[i].n_links for i in true} == {i: len(s) for i, s in true.items()}
    assert all(got[i].component_id == min({i, *true[i]}) for i in (1, 61, 93)) and got[94].kept


@pytest.mark.parametrize(("dim", "vectors"), ((64, 1_000), (64, 1_000_000), (768, 50_000)))
def test_recall_right_at_the_threshold(dim, vectors):
    rng = np.random.default_rng(4)
    codes, met = embedding_dedup.all_codes(dim, *embedding_dedup.plan_code(vectors, 0.93)), 0
    for _ in range(200):
        x, y = rng.standard_normal((2, dim))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        z = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y)
        met += len(np.intersect1d(embedding_dedup.all_filters(codes, x), embedding_dedup.all_filters(codes, z))) > 0
    assert met >= 0.95 * 200


def test_embeddings_keep_types_ties_and_names(spark):
    """Double components and labels are not rounded; clashing columns, equal vectors and an empty table."""
    x = [1.0, 1e30, 0.5]
    schema = "vec_id long, embedding array<double>, label double, rep string, filter int, copies int, label_2 int"
    rows = [(i, x, 1.2, "r", 0, 1, 2) for i in range(1500)] + [(2000, x, 1.7, None, None, None, None), (2001, [1.0, float("inf")], 1.2, None, None, None, None), (None, x, 1.2, None, None, None, None), (2002, [], 1.2, None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(frame).collect()}
    assert all(got[i] == (1499, 0, i == 0) for i in range(1500))
    assert got[2000] == (0, 2000, True) and got[2001] == (0, 2001, True) and got[2002] == (0, 2002, True) and got[None] == (0, None, None)
    assert embedding_dedup.dedup(spark.createDataFrame([], schema)).count() == 0


def test_deobfuscation():
    words = "idiot idiot loser pathetic the and there other moron trash clown".split() * 50
    from collections import Counter

    grams = toxicity._grams(Counter(words))
    lm = toxicity.Trigrams(np.array([toxicity.code(*g) for g in grams]), np.array(list(grams.values())))
    assert toxicity.decode("1d10t", lm) == "idiot" and toxicity.decode("l0s3r", lm) == "loser" and toxicity.decode("iidioooot", lm) == "idiot"
    assert toxicity.decode("m o r o n", lm) == "moron" and "pathetic" in toxicity.restored("p@thet1c!", lm)


def test_deobfuscation_without_gates():
    from collections import Counter

    words = "idiot idiot loser stupid asshole ass you are the and there other moron trash clown".split() * 50
    grams = toxicity._grams(Counter(words))
    lm = toxicity.Trigrams(np.array([toxicity.code(*g) for g in grams]), np.array(list(grams.values())))
    long = "stupid" * 20
    for token, word in (("1d10t", "idiot"), ("@$$h0l3", "asshole"), ("s--t--u--p--i--d", "stupid"), ("m" * 70 + "oron", "moron"), ("m" + "-" * 70 + "oron", "moron"), ("-".join(long), long)):
        assert word in toxicity.restored(token, lm) and word in toxicity.Reader(lm, None).text(f"you {token} there"), token
    for said, word in (("you a s s there", "ass"), ("you\ti\td\ti\to\tt", "idiot"), ("i  d  i  o  t", "idiot"), ("1 d\n1 0 t", "idiot")):
        assert word in toxicity.Reader(lm, None).text(said), said
    assert toxicity.decode("-".join("moron" * 4000), lm) == "moron" * 4000


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = [(i, " ".join([*rng.choices(plain, k=20), *(["vilecur"] if i % 4 == 0 else [])])) for i in range(400)] + [(400, None), (401, "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = by_id(toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and 0 <= got[400].score <= 1
    assert got[0].held_out == (zlib.crc32(b"0") % 4 == 2)
