"""The ten operators against brute force, round trips and held-out labels, and on awkward tables."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard, langid, licenses, mixing, pii, queries, repeats, sharding, vectors

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
AWKWARD = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "One", "b"), (5, "One", "b"), (6, "x " * 30_000, None), (7, "Is it the and of " * 40, "c"), (8, "\U0001f600 é 漢字 \r\n", "c")]


@pytest.fixture(scope="module")
def rows(duck):
    return duck.sql("select doc_id, text, lang, source from documents order by doc_id").fetchall()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(d, t, "en", s, 0, "clash", 5) for d, t, s in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, score string, shard int")


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        k = min(5, len(w))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    return out


def linked_classes(keys, pairs):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def jaccard_classes(rows):
    sets, by, both = shingle_sets(rows), collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    for ds in by.values():
        both.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    pairs = [(a, b) for (a, b), n in both.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    classes = linked_classes(sets, pairs)
    return {d: (len(sets[d]), classes[d]) for d in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_language_on_held_out_rows(spark, sf, rows):
    got = {r.doc_id: r for r in langid.op1_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    seen = [(got[d].lang_pred == lang) for d, t, lang, _ in rows if got[d].held_out and lang and got[d].lang_pred != "und"]
    assert len(seen) > 20 and sum(seen) / len(seen) > 0.95
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= got[d].score <= 1 for d, *_ in rows)


def test_language_spans(spark, sf):
    d = langid.documents(spark, sf)
    model = langid.trained(d)
    en, de = (" ".join(r.text for r in d.where(f"lang = '{x}' and length(text) > 500").limit(1).collect()) for x in ("en", "de"))
    row = langid.detect(spark.createDataFrame([(en + " " + de,)], "text string"), model, spans=True).first()
    assert {s["lang"] for s in row.spans} >= {"en", "de"} and row.spans[0]["lang"] == "en" and row.spans[-1]["lang"] == "de"


def test_sharding_is_exact(spark, sf, rows):
    got = sharding.op3_shard_documents(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_jaccard_classes(spark, sf, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op4_ngram_jaccard_join(spark, sf).collect()}
    assert got == jaccard_classes([r[:2] for r in rows])


def test_jaccard_near_the_threshold(spark):
    rng, docs = np.random.default_rng(3), []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(8, 160)))]
        for _ in range(5):
            w = list(words)
            for i in rng.integers(0, len(w), int(rng.integers(0, 1 + len(w) // 30))):
                w[i] = f"z{rng.integers(1 << 30)}"
            docs.append((len(docs), " ".join(w[int(rng.integers(0, 4)) :])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df).collect()}
    assert got == jaccard_classes(docs)


def test_bpe_equals_the_library(spark, sf, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    more = [(10_000, "<|endoftext|> a<|endoftext|>", 0, 0), (10_001, "\0special<|endoftext|>", 0, 0), (10_002, "ab" * 5000, 0, 0), (10_003, None, 0, 0), (10_004, "é́ 漢字 \U0001f600  \n\n\t x", 0, 0)]
    df = bpe.documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame([m[:2] for m in more], "doc_id long, text string"))
    got = {r.doc_id: r for r in bpe.digest(df, bpe.default_path()).collect()}
    for d, t, *_ in rows + more:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want, d


def embedding_rows(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [r.vec_id for r in e], np.array([r.embedding for r in e], dtype=float)


def test_embedding_links(spark, sf):
    ids, v = embedding_rows(spark, sf)
    norm = np.linalg.norm(v, axis=1)
    link = (v @ v.T) / norm[:, None] / norm[None, :] >= 0.9
    np.fill_diagonal(link, False)
    classes = linked_classes(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(link)), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.op6_embedding_near_dups(spark, sf).collect()}
    assert got == {k: (int(link[i].sum()), classes[k], classes[k] == k) for i, k in enumerate(ids)}


def test_nearest_neighbours_recall(spark, sf):
    ids, v = embedding_rows(spark, sf)
    got = collections.defaultdict(list)
    for r in vectors.op7_nearest_neighbours(spark, sf).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i, k in enumerate(ids):
        if k % 20 == 0:
            score = v @ v[i]
            want = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-score[j], ids[j]))[:20]
            mine = sorted(got[k])
            assert [x[0] for x in mine] == list(range(1, 21))
            hits, total = hits + len({ids[j] for j in want} & {x[1] for x in mine}), total + 20
            assert all(abs(s - v[ids.index(n)] @ v[i]) < 1e-12 for _, n, s in mine)
    assert hits / total >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 9: (2, 1)} | {k: (0, k) for k in (3, 4, 5, 6, 7, 8)}
    near = vectors.nearest(df, df, k=2, relax=1.0).collect()
    assert {(r.query_id, r.vec_id) for r in near} == {(a, b) for a in (1, 2, 9) for b in (1, 2, 9) if a != b}
    none = df.where("false")
    assert vectors.near_duplicates(none).isEmpty() and vectors.nearest(none, none).isEmpty()


def plain_removal(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            x = b[i : i + length]
            if x in seen:
                gone[i : i + length] = True
            seen.add(x)
        spots = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[d] = (len(b), int(gone.sum()), spots, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[:-1]].tobytes()).hexdigest())
    return out


def test_repeats_are_removed(spark, sf, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op8_repeat_removal(spark, sf).collect()}
    assert got == plain_removal([r[:2] for r in rows])


def test_repeats_in_awkward_texts(spark):
    rng = np.random.default_rng(5)
    part = "".join(chr(97 + i) for i in rng.integers(0, 26, 400))
    texts = ["a" * 700, "ab" * 300, part, "x" + part[50:260] + "y" + part[:150], part + part, None, "", part[:99], "a" * 99 + part[200:]]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == plain_removal(docs)


def test_surrogates(spark):
    text = "Mail anna.b@example.com or ANNA.B@example.com, call +49 170 1234567, Mr John Smith, card 4111 1111 1111 1111, ip 10.1.2.3, ssn 123-45-6789."
    df = spark.createDataFrame([(1, text), (2, "again anna.b@example.com and Mr John Smith"), (3, None), (4, "nothing here"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(df).collect()}
    again = {r.doc_id: r.text for r in pii.replace(df).collect()}
    new = got[1].text
    assert again == {k: r.text for k, r in got.items()}
    assert len(new) == len(text) or "Mr" in new
    for gone in ("anna.b@", "1234567", "John Smith", "4111 1111", "10.1.2.3", "123-45-6789"):
        assert gone not in new
    mail = re.search(r"[\w.]+@example\.com", new)[0]
    assert mail in got[2].text and mail.upper().split("@")[0] in new
    name = re.search(r"Mr (\w+ \w+)", new)[1]
    assert name in got[2].text and name.split()[0] in pii.GIVEN["m", "latin"]
    card = re.sub(r"\D", "", re.search(r"card ([\d ]+)", new)[1])
    assert pii.luhn(card[:-1]) == int(card[-1])
    assert got[3].text is None and got[4].text == "nothing here" and got[5].n_entities == 0


def test_surrogates_stay_distinct(spark):
    values = [f"u{i}@example.com" for i in range(100)] + [f"{i:03d}-12-{i + 1000}" for i in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    new = [r.text for r in pii.replace(df).collect()]
    assert len(set(new)) == len(values) and not set(new) & set(values)


def test_mix_hits_its_targets(spark, sf):
    got = mixing.op10_mix_sources(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source_size, r.target].append(r)
    for (size, target), rs in by.items():
        assert target <= 2 * size and abs(sum(r.taken for r in rs) - target) <= 2 * max(r.size for r in rs)


def test_awkward_rows(spark, awkward):
    n = len(AWKWARD)
    model = langid.train(awkward)
    assert {r.doc_id for r in langid.detect(awkward, model).where("lang_pred = 'und'").collect()} == {1, 2, 3}
    assert licenses.scan_licenses(awkward).count() == n
    assert sharding.shard(awkward, ["doc_id"], 3).groupBy("shard").count().count() == 3
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(awkward).collect()}
    assert got == {d: 4 if d == 5 else d for d, *_ in AWKWARD}
    assert bpe.digest(awkward, bpe.default_path()).count() == n
    assert repeats.remove_repeats(awkward).count() == n
    assert pii.replace(awkward).count() == n
    assert mixing.mix(awkward.withColumn("size", mixing.token_count(F.col("text")))).count() == n


def test_empty_table(spark, awkward):
    none = awkward.where("false")
    model = langid.train(none)
    for out in (langid.detect(none, model), licenses.scan_licenses(none), sharding.shard(none, ["doc_id"], 3), jaccard.similarity_classes(none), bpe.digest(none, bpe.default_path()), repeats.remove_repeats(none), pii.replace(none), mixing.mix(none.withColumn("size", F.lit(1)))):
        assert out.isEmpty()


def test_pipeline(spark, sf, rows):
    import corpus_pipeline as p

    docs = p.documents(spark, sf)
    one = p.language_id(spark, docs, sf)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {d for d, t, *_ in rows if t and any(map(str.isalpha, t))}
    two = p.near_duplicates(spark, docs, sf)
    assert {r.doc_id for r in two.collect()} == {d for d, (_, c) in jaccard_classes([r[:2] for r in rows]).items() if d == c}
    three = p.private_data(spark, two, sf)
    assert three.count() == two.count() and three.where("n_chars <> length(text)").isEmpty()
    four = p.mixing_weights(spark, docs, sf)
    taken = {r.doc_id: r.taken // r.size for r in mixing.op10_mix_sources(spark, sf).collect() if r.taken}
    assert dict(collections.Counter(r.doc_id for r in four.collect())) == taken
    assert p.bpe_encoding(spark, docs, sf).count() == len(rows)


#: Written down by hand, not taken from the operator's tables.
LICENCE_LINES = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("This work is licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"),
    ("Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under the Creative Commons Attribution-NoDerivs 2.0 Generic License.", "CC-BY-ND-2.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0"),
    ("SPDX-License-Identifier: CC0-1.0", "CC0-1.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Released under the MIT License.", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("All rights reserved.", "proprietary-notice"),
    ("Licensed under CC cake 4.0.", ""),
]


def licences_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    return [(",".join(got[i].licenses), got[i].unmatched) for i in range(len(texts))]


def test_licence_lines(spark):
    texts = [f"Some prose here.\n{line}\nMore prose." for line, _ in LICENCE_LINES]
    assert licences_of(spark, texts) == [(name, 0) for _, name in LICENCE_LINES]


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY %s "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = "3. Neither the name of %s nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
GPL_BODY = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
APACHE_BODY = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
HOLDER = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
LICENCE_BODIES = [
    (MIT_BODY, "MIT"),
    (BSD_BODY % ("", HOLDER), "BSD-2-Clause"),
    (BSD_BODY % (THIRD % "the copyright holder", HOLDER), "BSD-3-Clause"),
    (BSD_BODY % (THIRD % "Example Inc.", "THE REGENTS AND CONTRIBUTORS"), "BSD-3-Clause"),
    (GPL_BODY, "GPL-3.0-or-later"),
    (GPL_BODY.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), "GPL-2.0-or-later"),
    (APACHE_BODY, "Apache-2.0"),
]


@pytest.mark.parametrize("width, mark, end", [(10_000, "", "\n"), (70, "", "\n"), (78, "# ", "\n"), (72, " * ", "\r\n"), (60, "// ", "\n")])
def test_whole_licences(spark, width, mark, end):
    import textwrap

    wrap = lambda t: end.join((mark + line).rstrip() for p in t.split("\n\n") for line in [*textwrap.wrap(p.strip(), width), ""])
    texts = [f"{mark}Copyright (c) 2020 Somebody{end}{wrap(body)}" for body, _ in LICENCE_BODIES]
    assert licences_of(spark, texts) == [(name, 0) for _, name in LICENCE_BODIES]


def test_licence_sentences_between_others(spark):
    texts = ["Wow! Released under the MIT License. More.", "Which one? Licensed under CC BY 4.0.", "Copyright 2020 Somebody\nReleased under the MIT License\nfor all", "Not quite released under the MIT License.", "License: released under\n# the MIT License."]
    assert licences_of(spark, texts) == [("MIT", 0), ("CC-BY-4.0", 0), ("MIT", 0), ("", 0), ("MIT", 0)]


@pytest.mark.parametrize("values", [["a@example.com", "e@example.com", "i@example.com", "o@example.com"], [f"{a}@example.com" for a in "aeiou"], ["田中@example.com", "محمد@example.com"], ["Mrs " + n for n in ("Ab", "Eb", "Ib", "Ob", "Ub")], ["password: --------", "password: ========"]])
def test_surrogates_where_a_format_is_used_up(spark, values):
    df = spark.createDataFrame(list(enumerate([*values, *values])), "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.replace(df).collect()}
    first = [new[i] for i in range(len(values))]
    assert first == [new[i + len(values)] for i in range(len(values))]
    assert len(set(first)) == len(values) and not set(first) & set(values)


def test_all_short_local_parts(spark):
    consonants = "bcdfghjklmnpqrstvwxyz"
    values = [f"{a}{b}@example.com" for a in consonants for b in consonants]
    new = [r.text for r in pii.replace(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")).collect()]
    assert len(set(new)) == len(values) and not set(new) & set(values)


def test_mix_keeps_rows_without_doc_id(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(None if i == 3 else i, "some words here", "a") for i in range(6)], "doc_id long, text string, source string")
    assert {r.doc_id for r in p.mixing_weights(spark, docs, "").collect()} == {r.doc_id for r in mixing.mix(docs.withColumn("size", F.lit(3))).where("repeats > 0").collect()} >= {None}


def test_more_forms_of_private_data():
    text = "Then Anna Smith and Dr John Brown rang 555 123 4567 or 555.123.4567 from 2001:db8::1 and fe80:0:0:0:1:2:3:4 at 12:34:56 in std::list."
    assert [(text[a:b], k) for a, b, k in pii.entities(text)] == [("Anna Smith", "name_f"), ("John Brown", "name_"), ("555 123 4567", "phone"), ("555.123.4567", "phone"), ("2001:db8::1", "ipv6"), ("fe80:0:0:0:1:2:3:4", "ipv6")]
    assert pii.surrogate("ipv6", "2001:db8::1") == pii.surrogate("ipv6", "2001:0DB8:0::1") != pii.surrogate("ipv6", "2001:db8::2")
