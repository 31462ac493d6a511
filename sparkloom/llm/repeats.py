"""Removal of long passages that occur earlier in the corpus, by run-length indexes.

Any LENGTH bytes hold an anchor that their content alone determines: the smallest hash of their GRAM-byte
strings. Neighbouring windows of LENGTH bytes with one anchor form a piece, cut where the anchor comes into the
left half; so all windows of a piece share more than half of their bytes, whose hash is its key. Equal windows
meet at equal keys. Of equal pieces all but the first are repeats as a whole. Where a key has several pieces,
these are gathered in buckets, and each bucket gets a run-length index: the Burrows-Wheeler transform of its
pieces as runs, with text places sampled at the run ends. From the samples alone follow, for each place, the
place before it in suffix order and the length they share (its matching statistic); chains of places that share
LENGTH bytes are the occurrences of one passage, of which the earliest stays.

Pieces of a key with very many different ones are halved, each half with the longer key of its own windows,
until a key has few, or is a whole window, of which an aggregation finds the earliest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from . import bytestext as B
from .common import discard, documents, stash
from .jaccard import compress

#: Bytes of a passage and of an anchor's string.
LENGTH, GRAM = 100, 32
#: Pieces in a bucket on average, and the most of one key that meet in one.
BUCKET, MOST = 8192, 8192
#: Bytes of a text hashed at once.
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
#: Bytes of a window before its anchor: at most REACH, and at least HALF in the left piece.
REACH = LENGTH - GRAM
HALF = REACH // 2


def pieces(text: bytes) -> tuple[np.ndarray, ...]:
    """(start, end, place, key, content) of every piece of a text: its bytes, where its anchor is, the hash of what its
    windows share, and of all its bytes."""
    found, n = [], len(text)
    for at in range(0, max(0, n - LENGTH + 1), PIECE):
        # windows that start in this part
        b = np.frombuffer(text, np.uint8, min(n - at, PIECE + LENGTH - 1), at)
        h = B.prefix_hashes(b)
        start = np.arange(len(b) - GRAM + 1)
        gram = B.span_hashes(h, start, start + GRAM)
        p = (B.windowed_least((gram & ~_PLACE) | start.astype(np.uint64), REACH + 1) & _PLACE).astype(np.int64)
        left = p - start[: len(p)] >= HALF
        a = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (left[1:] != left[:-1])))
        z, p, left = np.append(a[1:], len(p)) - 1 + LENGTH, p[a], left[a]
        low, high = shared(p, np.where(left, HALF, 0), np.where(left, REACH, HALF - 1))
        key = B.span_hashes(h, low, high) + left
        found.append((a + at, z + at, p + at, key, B.mix(B.span_hashes(h, a, z) + (p - a).astype(np.uint64) * B.FACTORS[50])))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shared(p, least, most):
    """Bytes [low, high) that all windows with `least` to `most` bytes before an anchor at p have."""
    return p - least, p + LENGTH - most


def merged(a: np.ndarray, z: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals [a, z) that touch, by owner."""
    order = np.lexsort((z, a, of))
    a, z, of = a[order], z[order], of[order]
    if not len(a):
        return a, z, of
    # the furthest end so far within an owner
    _, owner = np.unique(of, return_inverse=True)
    span = np.int64(z.max() + 1)
    far = np.maximum.accumulate(z + owner * span) - owner * span
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (a[1:] > far[:-1])])
    first = np.flatnonzero(new)
    return a[first], far[np.append(first[1:], len(a)) - 1], of[first]


def find_pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(h, c, doc, a, size, p): pieces, h their key, c the hash of their bytes, p the anchor's place in them; or, p being
    null, bytes [a, a + size) of a document that repeat a piece met before in the same batch, so that no common piece
    is sent twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, rows = [], []
            keys = batch.column(0).to_pylist()
            for k, i in sorted((k, i) for i, k in enumerate(keys) if k is not None):
                t = batch.column(1)[i]
                if t.is_valid:
                    parts.append(pieces(t.as_buffer().to_pybytes()))
                    rows.append(np.full(len(parts[-1][0]), k, np.int64))
            if not parts:
                continue
            doc = np.concatenate(rows)
            a, z, p, g, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            # rows come by document and place: the first of each piece is the earliest
            _, first = np.unique(g ^ B.mix(c), return_index=True)
            live = np.zeros(len(p), bool)
            live[first] = True
            low, high, of = merged(a[~live], z[~live], doc[~live])
            n, m = int(live.sum()), len(low)
            own = B.mix(of.astype(np.uint64) * B.FACTORS[51] + low.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([g[live], own]).view(np.int64)),
                    pa.array(np.concatenate([c[live], np.zeros(m, np.uint64)]).view(np.int64)),
                    pa.array(np.concatenate([doc[live], of])),
                    pa.array(np.concatenate([a[live], low])),
                    pa.array(np.concatenate([(z - a)[live], high - low])),
                    pa.array(np.concatenate([(p - a)[live], np.zeros(m, np.int64)]).astype(np.int16), mask=np.arange(n + m) >= n),
                ],
                names=["h", "c", "doc", "a", "size", "p"],
            )

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "h long, c long, doc long, a long, size long, p short")


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Places of a text (symbols from 0 to 511) in the order of the suffixes there, by prefix doubling."""
    n, h = len(t), 7
    key = np.zeros(n, np.int64)
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(h, np.int64)])
    for k in range(h):
        key = key << 9 | padded[k : n + k]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        if rank[order[-1]] == n - 1:
            return order
        key = rank * (n + 1)
        if h < n:
            key[: n - h] += rank[h:] + 1
        h *= 2


class RunLengthIndex:
    """Burrows-Wheeler transform of a text as runs, with the text places at both ends of every run break."""

    def __init__(self, t: np.ndarray):
        order = suffix_order(t)
        before = t[order - 1]
        before[order == 0] = -1
        head = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbols, self.lengths = before[head], np.diff(np.append(head, len(t)))
        # sampled run ends: the first place of a run and the last one of the run before it
        place, last = order[head], np.where(head > 0, order[head - 1], -1)
        by_place = np.argsort(place)
        self.place, self.last = place[by_place], last[by_place]
        self.shared = self._common(t)

    def _common(self, t: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at the two samples of a run break share."""
        n, out = len(t), np.zeros(len(self.place), np.int64)
        act = np.flatnonzero(self.last >= 0)
        while len(act):
            x, y = self.place[act] + out[act], self.last[act] + out[act]
            act = act[(x < n) & (y < n)]
            x, y = self.place[act] + out[act], self.last[act] + out[act]
            act = act[t[x] == t[y]]
            out[act] += 1
        return out

    def matching(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places of the text: (place before it in suffix order, symbols shared), from the nearest sample."""
        s = np.searchsorted(self.place, at, "right") - 1
        ahead = at - self.place[s]
        return self.last[s] + ahead, np.where(self.last[s] < 0, 0, self.shared[s] - ahead)


def mark_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats (doc, a, z) among the pieces (doc, a, content) of a bucket."""
    rows = rows.sort_values(["doc", "a"], kind="stable")
    parts = [np.frombuffer(x, np.uint8) for x in rows["content"]]
    size = np.fromiter(map(len, parts), np.int64)
    start = np.cumsum(size + 1) - size - 1
    t = np.zeros(int(size.sum()) + len(size), np.int16)  # 0 ends a piece
    inside = np.ones(len(t), bool)
    inside[start + size] = False
    t[inside] = np.concatenate(parts).astype(np.int16) + 1
    windows = size - LENGTH + 1
    own = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = start[own] + offset
    before, common = RunLengthIndex(t).matching(at)
    # chains in suffix order to the first occurrence in it; any occurrence has as many bytes left
    chain = np.arange(len(t))
    same = common >= LENGTH
    chain[at[same]] = before[same]
    while True:
        further = chain[chain[at]]
        if (further == chain[at]).all():
            break
        chain[at] = further
    doc = rows["doc"].to_numpy()
    _, ordinal = np.unique(doc, return_inverse=True)
    begin = rows["a"].to_numpy()[own] + offset
    when = ordinal[own].astype(np.int64) << 40 | begin
    earliest = np.full(len(t), np.iinfo(np.int64).max)
    np.minimum.at(earliest, chain[at], when)
    late = earliest[chain[at]] != when
    a, z, of = merged(begin[late], begin[late] + LENGTH, doc[own][late])
    return pd.DataFrame({"doc": of, "a": a, "z": z})


PIECES = "h long, least short, most short, doc long, a long, p short, content binary"


def contents(marks: DataFrame, texts: DataFrame) -> DataFrame:
    """PIECES of marks (h, doc, a, size, p) with their bytes: windows with least to most bytes before the anchor.
    texts: (doc, z)."""
    wanted = marks.groupBy("doc").agg(F.collect_list(F.struct("h", "a", "size", "p")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            m = batch.column(2)
            own = np.repeat(np.arange(len(m)), np.diff(m.offsets.to_numpy()))
            h, a, size, p = (m.flatten().field(i) for i in range(4))
            texts_ = [un.decompress(z.as_py()) for z in batch.column(1)]
            content = [texts_[i][x : x + n] for i, x, n in zip(own.tolist(), a.to_pylist(), size.to_pylist(), strict=True)]
            left = p.to_numpy() >= HALF
            ends = [pa.array(np.where(left, x, y).astype(np.int16)) for x, y in ((HALF, 0), (REACH, HALF - 1))]
            doc = pa.array(batch.column(0).to_numpy()[own])
            yield pa.RecordBatch.from_arrays([h, *ends, doc, a, p, pa.array(content, pa.binary())], names=["h", "least", "most", "doc", "a", "p", "content"])

    return texts.join(wanted, "doc").select("doc", "z", "m").mapInArrow(run, PIECES)


def halves(rows: pd.DataFrame) -> pd.DataFrame:
    """Pieces cut in two by the bytes before the anchor, with the keys of their windows."""
    out = []
    for least, most, doc, a, p, content in rows[["least", "most", "doc", "a", "p", "content"]].itertuples(index=False):
        middle, h = (least + most) // 2, B.prefix_hashes(np.frombuffer(content, np.uint8))
        for low, high in ((least, middle), (middle + 1, most)):
            # windows of this piece that start with so many bytes before the anchor
            first, last = max(0, p - high), min(len(content) - LENGTH, p - low)
            if first <= last:
                x, y = shared(p, low, high)
                key = B.span_hashes(h, np.array([x]), np.array([y])) + np.uint64(low)
                out.append((int(key.view(np.int64)[0]), low, high, doc, a + first, p - first, content[first : last + LENGTH]))
    return pd.DataFrame(out, columns=["h", "least", "most", "doc", "a", "p", "content"])


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, a, z): byte ranges, overlapping, of what occurs earlier in LENGTH bytes or more."""
    # one shuffle by key serves both windows
    found = find_pieces(df, key, text).repartition("h")
    by = Window.partitionBy("h")
    of_piece = F.row_number().over(Window.partitionBy("h", "c").orderBy("doc", "a"))
    marks = found.withColumn("i", of_piece).withColumn("n", F.sum(F.when(F.col("i") == 1, 1).otherwise(0)).over(by))
    marks = stash(marks.where("p is null or i > 1 or n > 1").select("h", "doc", "a", "size", "p", "i", "n"))
    whole = marks.where("p is null or i > 1").select("doc", "a", (F.col("a") + F.col("size")).alias("z"))
    mixed = marks.where("p is not null and i = 1 and n > 1").select("h", "doc", "a", "size", "p")
    told, out = stash(contents(mixed, compress(df, key, text))), [whole]
    while True:
        counts = told.groupBy("h").agg(F.count("*").alias("n"))
        few = told.join(counts.where(F.col("n") > MOST), "h", "left_anti")
        deals = max(1, -(-told.count() // BUCKET))
        bucket = F.pmod(F.xxhash64("h"), F.lit(deals)).alias("bucket")
        # buckets are small and costly: as many partitions, which Spark would otherwise join by their size
        dealt = few.select(bucket, "doc", "a", "content").repartition(min(deals, BUCKET), "bucket")
        out.append(stash(dealt.groupBy("bucket").applyInPandas(mark_bucket, "doc long, a long, z long")))
        hot = stash(counts.where(F.col("n") > MOST))
        if hot.isEmpty():
            discard(told)
            break
        cut = stash(told.join(hot, "h").select(*told.columns).mapInPandas(lambda b: (halves(x) for x in b), PIECES))
        discard(told)
        # whole windows need no index: the earliest of each key stays
        one = cut.where("least = most").select("h", "doc", "a")
        first = one.groupBy("h").agg(F.min(F.struct("doc", "a")).alias("first"))
        late = one.join(first, "h").where(F.struct("doc", "a") > F.col("first"))
        out.append(stash(late.select("doc", "a", (F.col("a") + LENGTH).alias("z"))))
        told = cut.where("least < most")
        told = stash(told.join(told.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h", "left_semi"))
        discard(cut)
    return functools.reduce(DataFrame.unionByName, out)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) of every row: UTF-8 bytes, bytes in LENGTH-byte strings that
    also start earlier (smaller key, or same text and smaller offset), maximal removed runs, the bytes left.

    Null texts count as empty; texts below LENGTH bytes lose nothing. Keys are integers and unique: rows
    that share one lose what either repeats. Rows with a null key are left whole and are no source. Other columns
    are not read.
    """
    spans = repeated_spans(df, key, text).groupBy("doc").agg(F.collect_list(F.struct("a", "z")).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, m in zip(batch.column(1), batch.column(2), strict=True):
                raw = un.decompress(z.as_py())
                gone = spots = 0
                kept = raw
                if m.is_valid:
                    pairs = m.values
                    a, e, _ = merged(pairs.field("a").to_numpy(), np.minimum(pairs.field("z").to_numpy(), len(raw)), np.zeros(len(pairs), np.int64))
                    gone, spots, at, parts = int((e - a).sum()), len(a), 0, []
                    for x, y in zip(a.tolist(), e.tolist(), strict=True):
                        parts.append(raw[at:x])
                        at = y
                    kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), gone, spots, kept))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=[key, "n_bytes", "n_removed", "n_spans", "kept"])

    both = compress(df, key, text).join(spans, "doc", "left")
    return both.select("doc", "z", "m").mapInArrow(run, f"{key} long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeat_removal(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(documents(spark, sf_dir))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
