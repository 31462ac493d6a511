"""Spelling variants: the automaton on the trie, and the query, against plain Python."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import spelling


def near_words(a):
    """All words one edit away, by their letters only."""
    letters = "abc"
    out = {a[:i] + a[i + 1 :] for i in range(len(a))}
    out |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in letters}
    out |= {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in letters}
    return out - {a}


@pytest.mark.parametrize("size", [1, 10, 120])
def test_every_neighbour_is_found_once(size, monkeypatch):
    words = sorted("".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n))[::2][:size] + ["é\U0001f600x", "é\U0001f600", "é\U0001f600xy"]
    trie = spelling.Trie.of(words, np.arange(len(words)))
    again = spelling.Trie.unpacked(*trie.packed()[1:])
    asked = list(dict.fromkeys([*words, "", "aaa", "zzz", "bca", "\U0001f600x"]))
    for states in (1, 3, 1 << 18):
        monkeypatch.setattr(spelling, "STATES", states)
        w, node = again.near(asked)
        got = collections.Counter((asked[i], again.spelt(n)) for i, n in zip(w.tolist(), node.tolist(), strict=True))
        assert set(got.values()) <= {1}
        plain = {(a, b) for a in asked for b in words if b in near_words(a) or any(a[:i] + c + a[i:] == b or (i < len(a) and a[:i] + c + a[i + 1 :] == b) for i in range(len(a) + 1) for c in "é\U0001f600xy") and a != b}
        assert set(got) == plain


def plain_variants(counts, ratio=10):
    by, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            if (short := w[:i] + w[i + 1 :]) in counts:
                near[w].add(short)
                near[short].add(w)
    for same in by.values():
        for w in same:
            near[w] |= same - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def plain_counts(rows):
    c = collections.Counter()
    for d, text in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            r = r.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            if len(r) >= 7:
                c[r] += 1
    return {w: n for w, n in c.items() if n >= 2}


def test_registered_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in spelling.op12_spelling_variants(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_counts(docs))


def test_counts_of_odd_texts(spark):
    rows = [(i, "Separate seperate SEPARATE, ÀÉÎõøþÿ×÷ßß") for i in range(200)] + [(None, None), (None, "separate separate"), (7, ""), (8, "x" * 100_000 + " short"), (8, "x" * 100_000), (9, "naïveté_naïvetéİnaïveté")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("key", "run", "word", "n", "drawn")})
    got = {(r.word, r.n) for r in spelling.word_counts(df).collect()}
    assert got == set(plain_counts(rows).items())
    assert spelling.word_counts(df.where("false")).isEmpty()


def test_forms_chain_in_rounds_of_small_shards(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 3)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 2)
    monkeypatch.setattr(spelling, "ROUND_BYTES", 400)
    counts = {"aaaaaaa"[:i] + "b" * (7 - i): 10**i for i in range(8)} | {"zzzzzzz": 5, "zzzzzzy": 50, "zzzzzzx": 50, "qqqqqqq": 3, "a" * 5000: 2, "a" * 4999 + "c": 20, "é" * 7: 1}
    df = spark.createDataFrame([*counts.items(), ("", 4), (None, 4)], "word string, n long")
    got = {tuple(r) for r in spelling.spelling_variants(df).collect()}
    assert got == plain_variants(counts)
    assert {r[2] for r in got if r[0].startswith("b")} == {"a" * 7}  # a chain of seven forms
    assert spelling.spelling_variants(df.where("false")).isEmpty()


def test_rounds_hold_what_is_allowed():
    sizes = [(f"s{i}", s) for i, s in enumerate([10, 10, 25, 3, 3, 40])]
    groups = list(spelling.rounds(sizes, 25))
    assert sorted(x for g in groups for x in g) == sorted(s for s, _ in sizes)
    assert all(len(g) == 1 or sum(dict(sizes)[x] for x in g) <= 25 for g in groups)
