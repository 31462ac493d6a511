"""Byte-level BPE encoding and decoding with a given public vocabulary.

A pre-token's adjacent pairs are the leaves of a segment tree whose nodes keep the smallest (rank, place):
the root names the leftmost pair of lowest rank. A merge changes three leaves, each an update of
logarithmic cost, until the root holds no mergeable pair. The trees of many pre-tokens are rows of one
array, so every step advances all of them together; a pre-token of 100,000 bytes is a tree like any other.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .bytestext import runs
from .common import documents, text_batches

#: The split of byte-level BPE vocabularies of this family. Fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens kept between slices of a worker, and bytes in a slice. The store is emptied when full.
STORE, SLICE = 150_000, 1_000_000
#: Leaves of all trees handled at once.
FOREST = 1 << 19
NONE = np.iinfo(np.int64).max


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Vocabulary file as arrays: ids of single bytes, hashed pair -> (rank, merged id), bytes of each id."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, chars = spec["model"]["vocab"], byte_characters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.uint64) for i in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.byte_id = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = {c: b for b, c in chars.items()}
        text = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        parts = [text.get(i, b"") for i in range(max(text) + 1)]
        self.byte_start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self._hash(left << np.uint64(32) | right)

    def _hash(self, keys: np.ndarray) -> None:
        """Open addressing, a quarter full."""
        self.bits = max(4, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.rank = np.zeros(1 << self.bits, dtype=np.int64)
        wait, slot = np.arange(len(keys)), self._slot(keys)
        while len(wait):
            free = self.keys[slot[wait]] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[wait][free], return_index=True)
            put = wait[free][first]
            self.keys[slot[put]], self.rank[slot[put]] = keys[put], put
            wait = np.setdiff1d(wait, put)
            slot[wait] = (slot[wait] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 where the pair does not merge."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rank[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (there != np.iinfo(np.uint64).max)]
        return out


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_forest(v: Vocabulary, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words, one after the other, and how many each has. width: power of two, at least any length."""
    n, depth = len(words), width.bit_length() - 1
    length = np.fromiter(map(len, words), np.int64, n)
    column = np.arange(width)
    real = column < length[:, None]
    token = np.zeros((n, width + 1), dtype=np.int32)
    token[:, :width][real] = v.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
    right = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
    right[np.arange(n), length - 1] = width  # the place after the last
    left = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NONE)
    pair = column[:-1] < length[:, None] - 1
    rank = v.ranks(token[:, : width - 1][pair], token[:, 1:width][pair])
    leaf = np.where(rank < 0, NONE, rank << depth)
    tree[:, width : 2 * width - 1][pair] = leaf
    tree[:, width:] += np.where(tree[:, width:] == NONE, 0, column)
    for k in range(depth - 1, -1, -1):
        a = 1 << k
        np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2], out=tree[:, a : 2 * a])
    token, right, left, tree = token.ravel(), right.ravel(), left.ravel(), tree.ravel()
    alive = np.ones((n, width), dtype=bool)
    alive[~real] = False
    alive = alive.ravel()
    rows = np.flatnonzero(tree[1 :: 2 * width] != NONE)
    while len(rows):
        best = tree[rows * (2 * width) + 1]
        place, rank = best & (width - 1), best >> depth
        at, top = rows * (width + 1), rows * (2 * width)
        gone = right[at + place]
        after = right[at + gone]
        token[at + place] = v.merged[rank]
        right[at + place] = after
        alive[rows * width + gone] = False
        inner = after < width
        left[(at + after)[inner]] = place[inner]
        before = left[at + place]
        first = before >= 0
        # the three leaves that change: the removed place, the merged one and the one before it
        tree[top + width + gone] = NONE
        spot = np.concatenate([place, before[first]])
        own = np.concatenate([np.arange(len(rows)), np.flatnonzero(first)])
        next_ = np.concatenate([after, place[first]])
        rank = v.ranks(token[at[own] + spot], token[at[own] + np.minimum(next_, width)])
        none = (rank < 0) | (next_ >= width)
        tree[top[own] + width + spot] = np.where(none, NONE, (rank << depth) + spot)
        own = np.concatenate([np.arange(len(rows)), own])
        base, node = top[own], (width + np.concatenate([gone, spot])) >> 1
        for _ in range(depth):
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
            node >>= 1
        rows = rows[tree[top + 1] != NONE]
    left_over = alive.reshape(n, width)
    return token.reshape(n, width + 1)[:, :width][left_over], left_over.sum(1)


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, start, count): word i (none is empty) has ids[start[i] : start[i] + count[i]]."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    depth = np.ceil(np.log2(np.maximum(length, 2))).astype(int)
    start, count, parts, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0
    for d in np.unique(depth):
        which, step = np.flatnonzero(depth == d), max(1, FOREST >> d)
        for a in range(0, len(which), step):
            part = which[a : a + step]
            ids, n = merge_forest(v, [words[i] for i in part], 1 << int(d))
            start[part], count[part] = at + np.cumsum(n) - n, n
            parts.append(ids)
            at += len(ids)
    return np.concatenate(parts), start, count


class Encoder:
    """Encodes texts, keeping the ids of pre-tokens that it has met in one flat array."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.split = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.v.special):
            return PATTERN.findall(text)
        out = []
        for i, part in enumerate(self.split.split(text)):
            out += ["\0special" + part] if i % 2 else PATTERN.findall(part)
        return out

    def _add(self, new: list[str]) -> None:
        ids, start, count = encode_words(self.v, [w.encode() for w in new])
        for i, w in enumerate(new):
            if w.startswith("\0special") and w[8:] in self.v.special:
                ids, start[i], count[i] = np.append(ids, np.int32(self.v.special[w[8:]])), len(ids), 1
        self.place.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + start])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > STORE:
            self.clear()
        pieces = [self._pieces(t) for t in texts]
        flat = [w for p in pieces for w in p]
        new = set(flat) - self.place.keys()
        if new:
            self._add(list(new))
        where = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        ids, n = spread(self.flat, self.start[where], self.count[where])
        words = np.cumsum([len(p) for p in pieces])
        ends = np.concatenate([[0], np.cumsum(n)])[words]
        return np.split(ids, ends[:-1])


def spread(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start : start + count] of each, one after the other."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return flat[shift + np.arange(total)], count


class Decoder:
    """Bytes of ids, by whole arrays."""

    def __init__(self, v: Vocabulary):
        self.v, self.size = v, np.append(np.diff(v.byte_start), 0)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if not ids:
            return []
        known = [np.minimum(x, len(self.size) - 1) for x in ids]
        all_ = np.concatenate(known)
        raw, n = spread(self.v.flat, self.v.byte_start[np.minimum(all_, len(self.size) - 2)], self.size[all_])
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(x) for x in known])]
        return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _added(df: DataFrame, source: str, new: dict[str, tuple[T.DataType, pa.DataType]], make) -> DataFrame:
    """df with the columns that make() computes from slices of column `source`; out come the slices, so
    a task holds one incoming batch and one slice of results."""
    keep = [c for c in df.columns if c not in new]
    if source not in keep:
        keep.append(source)
    frame = text_batches(df).select(*keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            column = batch.column(keep.index(source))
            for a, b in runs(pc.fill_null(pc.binary_length(column), 0).to_pylist(), SLICE):
                part = batch.slice(a, b - a)
                made = fn(part.column(keep.index(source)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, t) for x, (_, t) in zip(made, new.values(), strict=True))], names=[*keep, *new])

    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *(T.StructField(n, t) for n, (t, _) in new.items())]))


IDS, TEXT = (T.BinaryType(), pa.binary()), (T.StringType(), pa.string())


def encode(df: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """df with the ids of each text as little-endian unsigned 32-bit integers in a binary column.

    A null text counts as empty: no ids. Strings of special tokens become their ids. Rows stand alone;
    a text is one value, so its size is bounded by the row. A column named like the result is replaced.
    """

    def make():
        e = Encoder(vocabulary(path))
        return lambda texts: [[x.astype("<u4").tobytes() for x in e.encode([t or "" for t in texts])]]

    return _added(df, text, {to: IDS}, make)


def decode(df: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """df with the text of packed ids (null: empty); bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""

    def make():
        d = Decoder(vocabulary(path))
        return lambda packed: [d.decode([np.frombuffer(x or b"", "<u4") for x in packed])]

    return _added(df, ids, {to: TEXT}, make)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode() and decode() of its ids in one pass: df with token_ids and decoded."""

    def make():
        e, d = Encoder(vocabulary(path)), Decoder(vocabulary(path))

        def both(texts: list) -> list[list]:
            packed = [x.astype("<u4").tobytes() for x in e.encode([t or "" for t in texts])]
            return [packed, d.decode([np.frombuffer(x, "<u4") for x in packed])]

        return both

    return _added(df, text, {"token_ids": IDS, "decoded": TEXT}, make)


def digest(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again."""
    d = round_trip(df.select("doc_id", "text"), path)
    return d.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_round_trip(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digest(documents(spark, sf_dir), path or default_path())
