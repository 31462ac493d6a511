"""Exact copies: the filters themselves, and the query against plain Python."""

import hashlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from sparkloom.llm import copies

ROWS = [
    (1, "a b"), (2, "ab"), (3, " a\tb \n"), (4, None), (5, ""), (6, "\x0b\x0c\r"), (None, "a  b "), (None, "a  b "), (7, "a b"), (8, "Ab"),
    (9, "x " * 60_000), (10, "x" * 60_000), (11, "alone"), (2, "ab"), (12, "\U0001f600 é"), (13, "\U0001f600é "), (3, " a\tb \n"),
]


def plain(rows):
    """Groups of normalised texts: size, winner (code points, then smallest key, nulls last)."""
    norm = [(t or "").translate({i: None for i in (0x20, *range(9, 14))}) for _, t in rows]
    by = {}
    for (d, t), n in zip(rows, norm, strict=True):
        by.setdefault(n, []).append((-len(t or ""), d is None, d or 0, d))
    return [(d, min(by[n])[3], len(by[n]), hashlib.sha256(n.encode()).hexdigest(), (-len(t or ""), d is None, d or 0, d) == min(by[n])) for (d, t), n in zip(rows, norm, strict=True)]


def test_rows_of_all_kinds(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("fp", "sha", "row", "key", "kept", "size", "clean", "n")})
    out = copies.exact_copies(df).collect()
    want = plain(ROWS)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=key) == sorted((w[:4] for w in want), key=key)
    kept = [r for r in out if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({w[3] for w in want})  # one of each group, repeated rows too
    best = {(w[0], w[3]) for w in want if w[4]}
    assert {(r.doc_id, r.text_sha256) for r in kept} == best


def test_no_rows_and_another_key(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert copies.exact_copies(df).isEmpty()
    out = copies.exact_copies(spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "name string, body string"), "name", "body")
    assert sorted((r.name, r.keep_id, r.kept) for r in out.collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


@pytest.mark.parametrize("bits", [1, 4, 10])
def test_filters_lose_nothing_and_merge(bits):
    rng = np.random.default_rng(bits)
    values = [rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (0, 1, 7, 3000)]
    values.append(np.concatenate([values[3][:500]] * 3 + [np.array([0, (1 << 64) - 1] * 4, dtype=np.uint64)]))
    # remainders that share a quotient, in one run
    values.append(np.arange(5, dtype=np.uint64) + (np.uint64(3) << np.uint64(60)))
    slices, want = {}, {}
    for v in values:
        found, counts = np.unique(v, return_counts=True)
        table = copies.encode(found, counts, bits)
        back = [copies.decode(*row, bits) for row in table.itertuples(index=False, name=None)]
        assert np.concatenate([b[0] for b in back] or [found]).tolist() == found.tolist() and np.concatenate([b[1] for b in back] or [counts]).tolist() == counts.tolist()
        for row in table.itertuples(index=False, name=None):
            slices.setdefault(row[0], []).append(row)
        for x, n in zip(found.tolist(), counts.tolist(), strict=True):
            want[x] = want.get(x, 0) + n
    got = {}
    for parts in slices.values():
        found, counts = copies.merge(parts, bits)
        assert (np.diff(found.astype(object)) > 0).all()
        got |= dict(zip(found.tolist(), counts.tolist(), strict=True))
    assert got == want


def test_small_filters_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(copies, "FILTER_ROWS", 50)
    rows = spark.range(2000).select((F.col("id") % 700 * 1_000_003 - 350_000_000).alias("fp")).repartition(7)
    got = {(r.fp, r.n) for r in copies.repeated_fingerprints(rows, "fp", 2000).collect()}
    assert got == {(i * 1_000_003 - 350_000_000, 3 if i < 600 else 2) for i in range(700)}


def test_equal_fingerprints_of_other_bytes(spark, monkeypatch):
    """Texts whose fingerprints clash are told apart by their bytes."""
    monkeypatch.setattr(copies.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(1, "ab"), (2, "cd"), (3, "a b"), (4, "ef"), (5, "c d")]
    got = {(r.doc_id, r.keep_id, r.group_size) for r in copies.exact_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w[:3] for w in plain(rows)}


def test_registered_query(spark, sf, duck):
    same_rows(copies.op11_exact_dedup(spark, sf), duck, copies.OP11_SQL)
