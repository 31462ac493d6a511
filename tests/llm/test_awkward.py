"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import jaccard_classes, plain_removal

import corpus_pipeline
from sparkloom.llm import bpe, jaccard, langid, licenses, mixing, pii, repeats, sharding

CLASHING = ["_d", "_s", "_b", "_l", "_p", "_h", "_q", "_i", "_before", "_text", "_id", "_n", "_", "kinds", "spans", "row", "doc", "z", "h", "c", "key", "part", "size", "count", "lang_pred", "component", "a", "b"]
#: Repeated rows, rows without a key, null, empty and long texts.
ROWS = [
    (1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, "One", "b"), (5, "One", "b"), (5, "One", "b"), (6, "x " * 30_000, None), (7, "Is it the and of " * 40, "c"),
    (None, "Is it the and of " * 40, "c"), (None, "Is it the and of " * 40, "c"), (8, "\U0001f600 é 漢字 \r\n", "c"), (9, "a" * 120_000, "c"), (10, "Mail x@example.com. All rights reserved.", "b"),
]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


def kept_columns(out, names):
    """The clashing columns that the operator does not say it replaces are as they were."""
    rows = out.select(*names).distinct().collect()
    assert [r.asDict() for r in rows] == [{c: f"own {c}" for c in names}]


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_language(table):
    out = langid.detect(table, langid.train(table), spans=True)
    kept_columns(out, [c for c in CLASHING if c not in ("spans", "lang_pred")])
    want = [(d, "und" if not t or not any(map(str.isalpha, t)) else "en", 0.0 if not t or not any(map(str.isalpha, t)) else 1.0) for d, t, _ in ROWS]
    assert values(out, "doc_id", "lang_pred", "score") == sorted(want, key=repr)


def plain_viterbi(scores, switch):
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        move = best[:, None] - switch * (1 - np.eye(len(best)))
        back.append(move.argmax(0))
        best = move.max(0) + s
    total, labels = best.max(), [int(best.argmax())]
    for b in reversed(back):
        labels.append(int(b[labels[-1]]))
    return total, labels[::-1]


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(4)
    texts = [rng.normal(size=(int(n), 4)) * 4 for n in rng.integers(1, 60, 80)]
    ends = np.cumsum([len(t) for t in texts])
    labels = langid.viterbi(np.concatenate(texts), ends, 5.0)
    for t, own in zip(texts, np.split(labels, ends[:-1]), strict=True):
        total, _ = plain_viterbi(t, 5.0)
        assert t[np.arange(len(t)), own].sum() - 5.0 * (np.diff(own) != 0).sum() == pytest.approx(total)


def test_licences(table):
    out = licenses.scan_licenses(table)
    kept_columns(out, CLASHING)
    assert values(out.where("unmatched > 0 or size(licenses) > 0"), "doc_id", F.array_join("licenses", ",")) == [(10, "proprietary-notice")]


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_sharding(table, block_rows):
    out = sharding.shard(table, ["doc_id", "text"], 3, block_rows=block_rows)
    kept_columns(out, CLASHING)
    assert values(out, "doc_id", "text") == sorted(((d, t) for d, t, _ in ROWS), key=repr)
    by = {}
    for s, slot in values(out, "shard", "slot"):
        by.setdefault(s, []).append(slot)
    assert sorted(map(len, by.values())) == [4, 4, 5] and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_sharding_query(spark, sf, duck):
    got = {r.doc_id: r for r in sharding.op3_shard_documents(spark, sf).collect()}
    for d, text in duck.sql("select doc_id, text from documents").fetchall():
        raw = (text or "").encode()
        assert (got[d].size, got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


@pytest.mark.parametrize("blocks, shards", [([5, 0, 7, 3], [4, 4, 7]), ([0], [0, 0]), ([1000, 3], [1, 1, 1001])])
def test_matrix_sums(blocks, shards):
    m = np.array(sharding.communication_matrix(blocks, shards, 3))
    assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and (m >= 0).all()


def test_shards_are_written_in_order(spark, table, tmp_path):
    df = table.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    placed = sharding.shard(df, ["doc_id"], 2)
    sharding.write_shards(df, placed, "doc_id", str(tmp_path / "out"), part_rows=3)
    for shard in (0, 1):
        want = [r.doc_id for r in placed.where(f"shard = {shard}").orderBy("slot").collect()]
        got = [[r.doc_id for r in spark.read.parquet(f"{tmp_path}/out/shard={shard}/part={p}").collect()] for p in range(-(-len(want) // 3))]
        assert sum(got, []) == want


def test_jaccard(table):
    got = values(jaccard.similarity_classes(table), "doc_id", "n_shingles", "component_id")
    sets = jaccard_classes([(d, t) for d, t, _ in ROWS if d is not None])
    assert got == sorted([(d, *sets[d]) if d is not None else (None, 5, None) for d, *_ in ROWS], key=repr)


def test_jaccard_of_repeated_keys(spark):
    base = [f"w{i}" for i in range(60)]
    near = [*base[:58], "y", "z"]
    rows = [(7, " ".join(base)), (3, " ".join(near)), (3, "something else"), (2, "something else"), (None, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert values(jaccard.similarity_classes(df), "doc_id", "component_id") == sorted([(7, 3), (3, 3), (3, 2), (2, 2), (None, None)], key=repr)


def test_jaccard_with_a_passage_in_thousands(spark, monkeypatch):
    # three quarters of every text is one passage: no links but those of the near copies among them
    monkeypatch.setattr(jaccard, "FLUSH", 20_000)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(48)]
    docs = [[*passage, *(f"d{d}x{rng.integers(1 << 30)}" for _ in range(16))] for d in range(2500)]
    for d in range(0, 2500, 50):
        docs[d + 1] = [*docs[d][:-1], "other"]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(df).collect()}
    assert got == {i: i - 1 if i % 50 == 1 else i for i in range(len(docs))}


def test_bytes_round_trip(table):
    out = bpe.round_trip(table, bpe.default_path())
    kept_columns(out, CLASHING)
    assert values(out, "doc_id", "decoded") == sorted(((d, t or "") for d, t, _ in ROWS), key=repr)


def test_repeats(table):
    named = [(d, t) for d, t, _ in ROWS if d is not None and d != 5]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in repeats.remove_repeats(table).collect() if r.doc_id not in (None, 5)}
    assert got == plain_removal(named)
    rest = [r for r in repeats.remove_repeats(table).collect() if r.doc_id in (None, 5)]
    assert len(rest) == 4 and all(r.n_removed == 0 for r in rest)


def test_repeats_with_hot_keys(spark, monkeypatch):
    # lines of 80 to 130 bytes in hundreds of texts between others, more than a key may have in a bucket
    monkeypatch.setattr(repeats, "MOST", 20)
    rng = np.random.default_rng(9)
    word = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    lines = [word(n) for n in (80, 99, 100, 105, 130)]
    docs = [(d, word(int(rng.integers(0, 90))) + lines[d % 5] + word(int(rng.integers(0, 90))) + (lines[d % 3] if d % 7 == 0 else "")) for d in range(400)]
    out = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    assert got == plain_removal(docs)


def test_surrogates(table):
    out = pii.replace(table)
    kept_columns(out, [c for c in CLASHING if c != "kinds"])
    got = values(out, "doc_id", "text", "n_entities")
    assert [(d, n) for d, _, n in got if n] == [(10, 1)]
    assert [x[:2] for x in got if not x[2]] == sorted(((d, t) for d, t, _ in ROWS if d != 10), key=repr)


def test_mix(table):
    sized = table.withColumn("size", mixing.token_count(F.col("text")))
    out = mixing.mix(sized)
    sizes = [(d, len((t or "").split())) for d, t, _ in ROWS]
    assert values(out, "doc_id", "size") == sorted(sizes, key=repr) and out.where("size = 0 and repeats > 0").isEmpty()
    total = sum(n for _, n in sizes)
    taken = out.agg(F.sum(F.col("size") * F.col("repeats"))).first()[0]
    assert 1.5 * total - 2 * max(n for _, n in sizes) <= taken <= 1.5 * total
    assert values(out, "doc_id", "size", "repeats") == values(mixing.mix(sized), "doc_id", "size", "repeats")


def documents_of(stage, spark, table, name):
    return corpus_pipeline.STAGES[[n for n, _ in corpus_pipeline.STAGES].index(name)][1](spark, table, "")


@pytest.mark.parametrize("name, want", [
    ("language ID", [(d, t) for d, t, _ in ROWS if t and any(map(str.isalpha, t))]),
    ("n-gram Jaccard join", [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (6, "x " * 30_000), (7, "Is it the and of " * 40), (None, "Is it the and of " * 40), (8, "\U0001f600 é 漢字 \r\n"), (9, "a" * 120_000), (10, ROWS[-1][1])]),
])
def test_stages(spark, table, name, want):
    out = documents_of(None, spark, table, name)
    assert out.columns == table.columns
    kept_columns(out, CLASHING)
    assert values(out, "doc_id", "text") == sorted(want, key=repr)


def test_stages_that_keep_all(spark, table):
    out = documents_of(None, spark, table, "PII")
    assert out.columns == table.columns and out.count() == len(ROWS)
    kept_columns(out, CLASHING)
    mixed = documents_of(None, spark, table, "mixing sources to target weights")
    assert mixed.columns == table.columns
    kept_columns(mixed, CLASHING)
    assert documents_of(None, spark, table, "BPE encoding and decoding").count() == len(ROWS)


def test_stages_on_an_empty_table(spark, table):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.where("false"), "").isEmpty()


def test_run(spark, sf):
    """The whole pipeline gives what its stages give one after the other."""
    docs = corpus_pipeline.documents(spark, sf)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = values(corpus_pipeline.run(spark, sf), *cols)
    assert got == values(docs, *cols) and len(got) > 100


#: Written down by hand, not taken from the operator's tables.
MORE_LICENCES = [
    ("This repo: released under the MIT License, see LICENSE.", "MIT"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Licensed under the GNU General Public License v2 or later.", "GPL-2.0-or-later"),
    ("Released under the terms of the BSD 3-Clause License.", "BSD-3-Clause"),
]


@pytest.mark.parametrize("width, mark", [(10_000, ""), (60, ""), (72, "# "), (66, " * ")])
def test_more_licences(spark, width, mark):
    import textwrap

    wrap = lambda t: "\n".join((mark + line).rstrip() for p in t.split("\n\n") for line in [*textwrap.wrap(p, width), ""])
    df = spark.createDataFrame([(i, f"{mark}Some words.\n\n{wrap(t)}") for i, (t, _) in enumerate(MORE_LICENCES)], "doc_id long, text string")
    got = dict(values(licenses.scan_licenses(df), "doc_id", F.array_join("licenses", ",")))
    assert [got[i] for i in range(len(MORE_LICENCES))] == [name for _, name in MORE_LICENCES]


def test_sentences_far_apart_are_no_licence(spark):
    parts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The software is provided as is, without warranty of any kind."]
    near, far = ("\n\n".join(parts), ("\n\n" + "Other words here. " * 300).join(parts))
    df = spark.createDataFrame([(1, near), (2, far)], "doc_id long, text string")
    assert values(licenses.scan_licenses(df), "doc_id", F.array_join("licenses", ","), "unmatched") == [(1, "MIT", 0), (2, "", 3)]
