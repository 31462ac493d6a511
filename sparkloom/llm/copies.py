"""Exact copies: counting quotient filters of fingerprints, merged by sorted remainders, then bytes compared.

A fingerprint of 64 bits is cut into a quotient, the number of a home slot, and a remainder. A filter keeps the
remainders of each quotient as a sorted run, marks which quotients have one and where runs end, and keeps a counter
for remainders met more than once. Nothing of a fingerprint is lost, so filters made apart merge into the filter of
all rows by merging sorted runs and adding counters, whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import documents, stash

#: What texts are compared without: space and the controls 0x09 to 0x0D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Fingerprints that a task gathers before it closes a filter, and distinct ones in a range of quotients of the merged
#: filter, about. LOAD: remainders for each quotient at most.
FILTER_ROWS, RANGE_ROWS, LOAD = 1 << 20, 1 << 18, 0.95
#: Ranges at least, so that the merge of a small table has some tasks too.
RANGE_BITS = 10
SLICE = "range long, quotient_bits int, occupied binary, ends binary, remainders binary, counters binary"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def encode(fingerprints: np.ndarray, counts: np.ndarray, range_bits: int) -> pd.DataFrame:
    """A filter of sorted, distinct uint64 fingerprints and their counts: a row for each range of quotients that holds any.

    occupied has a bit for each quotient of the range, ends a bit for each slot that closes a run, counters the slots and
    counts above one.
    """
    q = range_bits + max(0, int(np.ceil(np.log2(max(1, len(fingerprints)) / LOAD))) - range_bits)
    r = 64 - q
    owner = (fingerprints >> np.uint64(64 - range_bits)).astype(np.int64)
    quotient = ((fingerprints >> np.uint64(r)) & np.uint64((1 << (q - range_bits)) - 1)).astype(np.int64)
    remainder = np.ascontiguousarray(fingerprints & np.uint64((1 << r) - 1)).view(np.uint8).reshape(-1, 8)[:, : -(-r // 8)]
    cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own = quotient[lo:hi]
        occupied = np.zeros(1 << (q - range_bits), dtype=bool)
        occupied[own] = True
        ends = np.append(own[1:] != own[:-1], True)
        more = np.flatnonzero(counts[lo:hi] > 1)
        counters = np.stack([more, counts[lo:hi][more]]).astype(np.int64).tobytes()
        rows.append((int(owner[lo]), q, np.packbits(occupied).tobytes(), np.packbits(ends).tobytes(), remainder[lo:hi].tobytes(), counters))
    return pd.DataFrame(rows, columns=["range", "quotient_bits", "occupied", "ends", "remainders", "counters"])


def decode(owner: int, q: int, occupied: bytes, ends: bytes, remainders: bytes, counters: bytes, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints in order, counts) of a range of a filter."""
    r = 64 - q
    width = -(-r // 8)
    low = np.zeros((len(remainders) // width, 8), dtype=np.uint8)
    low[:, :width] = np.frombuffer(remainders, dtype=np.uint8).reshape(-1, width)
    run = np.cumsum(np.unpackbits(np.frombuffer(ends, dtype=np.uint8))[: len(low)])
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(occupied, dtype=np.uint8))).astype(np.uint64)
    high = quotients[np.concatenate([[0], run[:-1]]).astype(np.int64)]
    found = (np.uint64(owner) << np.uint64(64 - range_bits)) | (high << np.uint64(r)) | low.view(np.uint64).ravel()
    counts = np.ones(len(found), dtype=np.int64)
    at, n = np.frombuffer(counters, dtype=np.int64).reshape(2, -1)
    counts[at] = n
    return found, counts


def merge(slices: list[tuple], range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices of one range as one: sorted runs are merged, counts of equal remainders added."""
    parts = [decode(*s, range_bits) for s in slices]
    found, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(found, kind="stable")  # the parts are sorted runs
    found, counts = found[order], counts[order]
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    return found[first], np.add.reduceat(counts, first)


def repeated_fingerprints(rows: DataFrame, fingerprint: str, count: int) -> DataFrame:
    """(fingerprint, n) of the fingerprints (long) that more than one of `count` rows has. Every task puts its rows into
    filters; filters are dealt by ranges of quotients, and a range is merged in a task. A fingerprint that many rows share
    is one slot with a counter in each filter."""
    bits = max(RANGE_BITS, int(np.ceil(np.log2(max(1, count) / RANGE_ROWS))))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch[fingerprint].to_numpy().view(np.uint64))
            n += len(batch)
            if n >= FILTER_ROWS:
                yield encode(*np.unique(np.concatenate(held), return_counts=True), bits)
                held, n = [], 0
        if n:
            yield encode(*np.unique(np.concatenate(held), return_counts=True), bits)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, found = [], []

        def close() -> None:
            fps, counts = merge(held, bits)
            found.append(pd.DataFrame({fingerprint: fps[counts > 1].view(np.int64), "n": counts[counts > 1]}))
            held.clear()

        for batch in batches:
            for part in batch.itertuples(index=False, name=None):
                if held and held[0][0] != part[0]:
                    close()
                held.append(part)
            if found:
                yield pd.concat(found)
                found.clear()
        if held:
            close()
            yield pd.concat(found)

    filters = rows.select(fingerprint).mapInPandas(build, SLICE)
    return filters.repartition("range").sortWithinPartitions("range").mapInPandas(merged, f"{fingerprint} long, n long")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of docs.

    Texts are equal when they are identical without SPACE; a null text is empty, and all empty texts are one group. Of a
    group the row with the most code points in its text stays, of those the one with the smallest key, null keys last; of
    rows that agree in both exactly one, so repeated rows and rows without a key have one row with kept = true. Other
    columns are not looked at. An empty table gives an empty one.

    Only rows whose fingerprint is repeated are compared by bytes: equal bytes meet in an aggregation that starts before
    the shuffle, so a task sends each text once however often it holds it.
    """
    clean = normalised(F.col(text))
    digest = F.unhex(F.sha2(clean, 256))
    # a row is told from its like by a number that is drawn once, when the table is written
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(clean).alias("fp"), F.coalesce(F.length(text), F.lit(0)).alias("size"), digest.alias("sha")))
    often = stash(repeated_fingerprints(rows, "fp", rows.count()))
    again = docs.select(F.xxhash64(clean).alias("fp"), clean.alias("clean")).join(often.select("fp"), "fp", "left_semi")
    equal = again.groupBy("fp", "clean").agg(F.count("*").alias("group_size")).where("group_size > 1")
    equal = stash(equal.select("fp", F.unhex(F.sha2("clean", 256)).alias("sha"), "group_size"))
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("key").isNull().alias("none"), "key", "row")).alias("best")
    chosen = rows.join(equal, ["fp", "sha"]).groupBy("fp", "sha", "group_size").agg(best)
    chosen = stash(chosen.select("fp", "sha", "group_size", F.col("best.key").alias("best_key"), F.col("best.row").alias("best_row")))
    out = rows.join(chosen, ["fp", "sha"], "left")
    alone = F.col("best_row").isNull()
    return out.select(
        F.col("key").alias(key), F.when(alone, F.col("key")).otherwise(F.col("best_key")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_copies(documents(spark, sf_dir))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c from documents),
g as (select *, count(*) over (partition by c) as n, first_value(doc_id) over (partition by c order by length(t) desc, doc_id) as keep_id from d)
select doc_id, keep_id, n as group_size, doc_id = keep_id as kept, sha256(c) as text_sha256 from g"""
