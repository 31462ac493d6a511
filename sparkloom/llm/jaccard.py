"""N-gram Jaccard join by parity sketches.

Every shingle flips one bit of a document's sketch, so two sketches differ in no more bits than the
shingle sets differ in elements. Documents of a size band that reach the threshold differ in at most D
elements, D by the band; cut into more than D blocks, their sketches agree in some blocks. A block is so wide
(2^64 bits, of which the XOR of its shingles' hashes stands for those set) that blocks agree only if they have
the same shingles. As linked documents agree in several blocks, each document leaves out those of none or one
shingle and its most crowded ones. Documents that agree in a block of a band are candidates; sketches as long
as the sets then rule most out, and the others are verified on their whole sets.

A block shared by many documents gives each of them one candidate, the smallest document of the block.
Where this leaves several components in a block, documents are compared across them as far as their sketches allow
a link: first with one partner each, then, as components join, with more, until none is left to compare. So no link
between components is lost and no clique is expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import bytestext as B
from .common import components, discard, documents, stash, text_batches

#: Words in a shingle and the least similarity, as a percentage.
WORDS, PERCENT = 5, 80
#: Ratio between the ends of a size band, and the blocks above D as a share of D.
BAND, SPARE = 1.4, 0.3
#: Shingles of a block that count when the fewest are left out; a single one is shared by chance.
FULL = 2
#: Hash values by which the documents of a block are counted.
SLOTS = 1 << 21
#: Keys gathered in a task before they are sent on, as many of one key there as meet before they are sent, and
#: keys in a part of the key space on average.
FLUSH, MEET, PART = 250_000, 8, 500_000
#: Documents that are compared with one lead in a group, and rows of a block on one side of a comparison.
GROUP, TILE = 256, 1024
#: Partners of a document in a block that are verified before components are found again, round by round; then all.
ROUNDS = (1, 64)
#: Bits of a document's sketch for each element: with 8, a Hamming distance rules out all but 0.795 to 0.8.
BITS = 8
#: Rows of blocks compared in a task, on average.
OPEN = 20_000


def bands(percent: int = PERCENT, up_to: int = 1 << 40) -> list[tuple[int, int]]:
    """(first size, most differing elements) of each band. Sizes in a band below the next's first size.

    Sets of sizes a <= b with 100 * common >= percent * union differ in at most
    (100 - percent) / (100 + percent) * (a + b) elements, at most twice that share of b.
    """
    share, out, low = Fraction(100 - percent, 100 + percent), [], 1
    while low < up_to:
        high = max(low + 1, int(low * BAND))
        out.append((low, int(share * 2 * (high - 1))))
        low = high
    return out


class Blocks:
    """Blocks of the parity sketches of shingle sets, many sets at once.

    The larger document of a pair names the band, so a set goes into its own band and into those after it that
    have sets similar to it. Bands with D = 0 are left out: their sets are similar only if equal.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, table = percent, bands(percent)
        self.first, self.most = (np.array(x) for x in zip(*table, strict=True))
        self.last = np.append(self.first[1:], 1 << 40) - 1

    def words(self, s: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(set, key, filled, blocks, drop, own) for the first band of every set, then for the second, and so on.

        set, blocks, drop, own: one entry for a set. key, filled: one for a block, set by set; filled: its shingles.
        Documents that are linked agree in more than `drop` blocks of either of them. own: the band is the set's own."""
        own = band = np.searchsorted(self.first, n, "right") - 1
        start, live = np.cumsum(n) - n, n > 0
        while live.any():
            use = np.flatnonzero(live & (self.most[band] > 0))
            if len(use):
                b, size = band[use], n[use]
                d, tag = self.most[b], B.mix(B.FACTORS[40] + b.astype(np.uint64))
                m = d + 1 + np.maximum(2, (SPARE * d).astype(np.int64) + 1)
                # the partner is in the band or below it, and similar
                partner = np.minimum(self.last[b], 100 * size // self.percent)
                drop = m - 1 - (100 - self.percent) * (size + partner) // (100 + self.percent)
                of, to = np.repeat(np.arange(len(use)), size), np.cumsum(m) - m
                h = B.mix(s[np.arange(len(of)) + np.repeat(start[use] - (np.cumsum(size) - size), size)] + tag[of])
                block = ((h >> np.uint64(32)) * m.astype(np.uint64)[of] >> np.uint64(32)).astype(np.int64) + to[of]
                word = np.zeros(int(m.sum()), np.uint64)
                np.bitwise_xor.at(word, block, B.mix(h ^ B.FACTORS[45]))
                place = (np.arange(len(word)) - np.repeat(to, m)).astype(np.uint64)
                yield use, B.mix(word + B.mix(np.repeat(tag, m) + place * B.FACTORS[41])), np.bincount(block, minlength=len(word)), m, drop, b == own[use]
            band = np.minimum(band + 1, len(self.first) - 1)
            live &= 100 * n >= self.percent * self.first[band]

    def keys(self, s: np.ndarray, n: np.ndarray, crowd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set, key): the keys by which a set meets its candidates, without `drop` of each band: those of fewer than
        FULL shingles, then the most crowded.

        All documents order blocks that agree alike, so the last of those that two linked documents agree in comes
        after more than `drop` others in both: neither of them leaves it out. Any crowd will do, by hash of the
        key; it only decides how many documents meet in vain. The lowest bit of a key is 1 in the set's own band:
        a block without such a set has no pair to test. The next bit is 0."""
        for use, key, filled, m, drop, own in self.words(s, n):
            of = np.repeat(np.arange(len(use)), m)
            rank = of << 32 | np.minimum(filled, FULL) << 16 | (65535 - crowd[(key & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.int64))
            order = np.argsort(rank, kind="stable")
            order = order[np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) >= drop[of]]
            of = of[order]
            yield use[of], key[order] & ~np.uint64(3) | own[of].astype(np.uint64)


def sketches(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number of words of each set): parity sketches of sets, each of a power of two of bits, BITS or more for
    an element. A sketch of twice the bits becomes one of half by XOR of its halves."""
    long = np.where(n > 0, 1 << np.maximum(0, np.ceil(np.log2(BITS * np.maximum(n, 1))).astype(np.int64) - 6), 0)
    of = np.repeat(np.arange(len(n)), n)
    at = (B.mix(s ^ B.FACTORS[43]) & (64 * long - 1).astype(np.uint64)[of]).astype(np.int64)
    word = np.zeros(int(long.sum()), np.uint64)
    np.bitwise_xor.at(word, (at >> 6) + (np.cumsum(long) - long)[of], np.uint64(1) << (at & 63).astype(np.uint64))
    return word, long


def _raw(texts: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


def describe(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, n, h1, h2, x, z): set size, 128-bit hash of the set, its sketch and the text as a zstandard frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw = _raw(batch.column(1))
            for low, s, n in B.shingle_sets(raw, WORDS):
                start = np.cumsum(n) - n
                h = [np.add.reduceat(np.append(B.mix(v), np.uint64(0)), start) * (n > 0).astype(np.uint64) for v in (s, s ^ B.FACTORS[44])]
                word, long = sketches(s, n)
                x = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(long)), pa.int32()), pa.array(word.view(np.int64)))
                z = pa.array([c.compress(t) for t in raw[low : low + len(n)]], pa.binary())
                cols = [batch.column(0).slice(low, len(n)), pa.array(n, pa.int64()), *(pa.array(v.view(np.int64)) for v in h), x, z]
                yield pa.RecordBatch.from_arrays(cols, names=["doc", "n", "h1", "h2", "x", "z"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "doc long, n long, h1 long, h2 long, x array<long>, z binary")


def count_keys(texts: DataFrame, percent: int) -> np.ndarray:
    """How crowded the blocks of all documents are: the documents of each of SLOTS hash values of their keys, as a
    logarithm in 16 bits. A table of this one size, however many the documents. texts: (doc, z)."""
    slices = 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, blocks, counts = zstandard.ZstdDecompressor(), Blocks(percent), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, s, n in B.shingle_sets([un.decompress(z.as_py()) for z in batch.column(0)], WORDS):
                for _, key, *_ in blocks.words(s, n):
                    np.add.at(counts, (key & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        if counts.any():
            c = zstandard.ZstdCompressor(level=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([c.compress(x.tobytes()) for x in np.split(counts, slices)], pa.binary())], names=["slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        un, total = zstandard.ZstdDecompressor(), np.zeros(SLOTS // slices, np.int64)
        for x in rows["counts"]:
            total += np.frombuffer(un.decompress(x), np.int64)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "level": [(np.log2(total + 1) * 1000).astype(np.uint16).tobytes()]})

    crowd = np.zeros((slices, SLOTS // slices), np.uint16)
    found = texts.select("z").mapInArrow(run, "slice int, counts binary")
    for r in found.groupBy("slice").applyInPandas(add, "slice int, level binary").collect():
        crowd[r["slice"]] = np.frombuffer(r["level"], np.uint16)
    return crowd.reshape(-1)


def _met(key: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """(order, size of the block, lead, near) of rows, in their order by block; lead: the smallest document of the
    block that is in its own band there, or -1; near: it is another one, and the sizes allow a link."""
    order = np.lexsort((doc, key >> np.uint64(2)))
    key, doc, size = key[order], doc[order], size[order].astype(np.int64)
    own, key = key & np.uint64(1) > 0, key >> np.uint64(2)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    many, none = np.diff(np.append(head, len(key))), np.iinfo(np.int64).max
    lead = np.repeat(np.minimum.reduceat(np.where(own, doc, none), head), many) if len(key) else doc
    of_lead = np.repeat(np.maximum.reduceat(np.where(doc == lead, size, 0), head), many) if len(key) else size
    near = (lead != doc) & (lead != none) & (100 * np.minimum(size, of_lead) >= percent * np.maximum(size, of_lead))
    return order, np.repeat(many, many), np.where(lead == none, -1, lead), near


def deal_keys(texts: DataFrame, parts: int, percent: int, crowd: np.ndarray) -> DataFrame:
    """(part, keys, docs, more): block keys of all documents, packed by part of the key space; more: their set sizes.
    texts: (doc, z).

    Of a key that many documents of a task have, one is sent on with the key's second bit set, the others meet it
    here: so a key that a large share of all documents has is no large group. Their rows have a part below 0 and
    pairs (lead or -1, near) in `more`."""
    shared = texts.sparkSession.sparkContext.broadcast(crowd)  # SLOTS entries of 16 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        un, blocks, keys, docs, held = zstandard.ZstdDecompressor(), Blocks(percent), [], [], 0

        def flush() -> pa.RecordBatch:
            k, (d, size) = np.concatenate(keys), np.concatenate(docs, axis=1)
            order, many, lead, near = _met(k, d, size, percent)
            k, d, size = k[order], d[order], size[order].astype(np.int32)
            first = np.append(True, k[1:] >> np.uint64(2) != k[:-1] >> np.uint64(2))
            stays = np.where(lead < 0, first, d == lead)
            gone = (many >= MEET) & ~stays
            rows = []
            if gone.any():
                to = -1 - int(B.mix(k[:1])[0] % np.uint64(parts))
                rows.append((to, k[gone].tobytes(), d[gone].tobytes(), np.stack([lead[gone], near[gone]], axis=1).tobytes()))
            k = k | (many >= MEET).astype(np.uint64) << np.uint64(1)
            k, d, size = k[~gone], d[~gone], size[~gone]
            part = ((k >> np.uint64(2)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            k, d, size, cut = k[order], d[order], size[order], np.searchsorted(part[order], np.arange(parts + 1))
            rows += [(p, *(v[a:b].tobytes() for v in (k, d, size))) for p, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if b > a]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=["part", "keys", "docs", "more"])

        for batch in batches:
            doc = batch.column(0).to_numpy()
            for low, s, n in B.shingle_sets([un.decompress(z.as_py()) for z in batch.column(1)], WORDS):
                for of, key in blocks.keys(s, n, shared.value):
                    keys.append(key)
                    docs.append(np.stack([doc[low + of], n[of]]))
                    held += len(key)
                if held > FLUSH:
                    yield flush()
                    keys, docs, held = [], [], 0
        if held:
            yield flush()

    return texts.select("doc", "z").mapInArrow(run, "part int, keys binary, docs binary, more binary")


def star_candidates(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(key, lead, doc, near): every document of a block with the smallest one that is in its own band there. near:
    their sizes allow a link. key is null in a block of two, where no other pair is left to test; these come once,
    if near. lead is -1 if it is not known here."""
    key, doc = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("keys", np.uint64), ("docs", np.int64)))
    if rows["part"].iloc[0] < 0:
        lead, near = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in rows["more"]]).T
        return pd.DataFrame({"key": pd.array((key >> np.uint64(2)).view(np.int64), dtype="Int64"), "lead": lead, "doc": doc, "near": near > 0})
    size = np.concatenate([np.frombuffer(x, np.int32) for x in rows["more"]])
    order, many, lead, near = _met(key, doc, size, percent)
    doc, key, more = doc[order], key[order] >> np.uint64(2), key[order] & np.uint64(2) > 0
    open_ = np.isin(key, key[(many > 2) | more])
    met = (many > 1) & (lead >= 0) & (lead != doc) & (near | open_)
    out = pd.DataFrame({"key": pd.array(key[met].view(np.int64), dtype="Int64"), "lead": lead[met], "doc": doc[met], "near": near[met]})
    out.loc[~open_[met], "key"] = pd.NA
    return out.drop_duplicates()


def _allowed(a: str, b: str, percent: int):
    """Sizes and sketches of a and b do not rule out a link."""
    na, nb, x, y = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.x"), F.col(f"{b}.x")
    half = lambda v: (F.size(v) / 2).cast("int")
    folded = lambda v: F.zip_with(F.slice(v, F.lit(1), half(v)), F.slice(v, half(v) + 1, half(v)), lambda p, q: p.bitwiseXOR(q))
    to = lambda v, other: F.when(F.size(v) > F.size(other), folded(v)).otherwise(v)
    differ = F.aggregate(F.zip_with(to(x, y), to(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return F.when(near, (100 + percent) * differ <= (100 - percent) * (na + nb)).otherwise(False)


def partners(rows: pd.DataFrame, percent: int, most: int) -> pd.DataFrame:
    """(a, b, more): of every document b of a block the first `most` smaller ones of other components to which sizes and
    sketches allow a link; more: there are others. rows: (key, i, j, tile, doc, c, n, x) of many blocks, of a large
    one two tiles i and j, between which (or, both being one, in which) documents are compared."""
    rows = rows.sort_values(["key", "i", "j", "doc"], kind="stable")
    block = rows[["key", "i", "j"]].to_numpy()
    head = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1)))
    doc, c, n, tile, x = (rows[k].to_numpy() for k in ("doc", "c", "n", "tile", "x"))
    out = []
    for s, e in zip(head, np.append(head[1:], len(rows)), strict=True):
        size = min(len(v) for v in x[s:e])
        # XOR of the halves of a longer sketch, down to the shortest
        bits = np.stack([np.bitwise_xor.reduce(np.asarray(v, np.int64).reshape(-1, size), axis=0) for v in x[s:e]]).view(np.uint64)
        for p in range(s, e, TILE):
            q = min(e, p + TILE)
            differ = np.zeros((q - p, q - s), np.int64)
            for w in range(size):
                differ += np.bitwise_count(bits[p - s : q - s, w, None] ^ bits[None, : q - s, w])
            both = n[p:q, None] + n[None, s:q]
            may = ((100 + percent) * differ <= (100 - percent) * both) & (c[p:q, None] != c[None, s:q]) & (doc[p:q, None] > doc[None, s:q])
            may &= 100 * np.minimum(n[p:q, None], n[None, s:q]) >= percent * np.maximum(n[p:q, None], n[None, s:q])
            if block[s, 1] != block[s, 2]:
                may &= tile[p:q, None] != tile[None, s:q]
            place = np.cumsum(may, axis=1)
            b, a = np.nonzero(may & (place <= most))
            out.append(np.stack([doc[s + a], doc[p + b], place[b, -1] > most]))
    a, b, more = np.concatenate(out, axis=1)
    return pd.DataFrame({"a": a, "b": b, "more": more > 0}).drop_duplicates()


def open_pairs(known: DataFrame, group: DataFrame, reps: DataFrame, percent: int, most: int) -> DataFrame | None:
    """(a, b, more) of partners() over the blocks, known as (key, doc), in which several components meet. Blocks of the
    same documents count once; a block with many is dealt to pairs of tiles of about TILE. None: there is no such block."""
    own = known.join(group, F.col("doc") == F.col("id"), "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    same = [F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"s{i}") for i in (1, 2)]
    blocks = own.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count("*").alias("size"), *same).where("least < most")
    blocks = blocks.groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    rows = stash(own.join(blocks, "key").join(reps, "doc").withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")))
    count = rows.count()
    if not count:
        return None
    deals = -(-count // OPEN)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = rows.withColumn("other", other).select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "doc", "c", "n", "x")
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("key", "i", "j"), F.lit(deals)))
    return dealt.groupBy("deal").applyInPandas(lambda g: partners(g, percent, most), "a long, b long, more boolean")


def compare(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b) of the documents of a group that are linked to its lead, whose own row has doc = a."""
    un, lead = zstandard.ZstdDecompressor(), int(rows["a"].iloc[0])
    texts, docs = [un.decompress(z) for z in rows["z"]], rows["doc"].to_numpy()
    first, out = B.shingles(texts[int(np.flatnonzero(docs == lead)[0])], WORDS), []
    for low, s, n in B.shingle_sets(texts, WORDS):
        here = (first[np.minimum(np.searchsorted(first, s), len(first) - 1)] == s).astype(np.int64)
        both = np.add.reduceat(np.append(here, 0), np.cumsum(n) - n)
        out.append(docs[low : low + len(n)][100 * both >= percent * (len(first) + n - both)])
    linked = np.unique(np.concatenate(out))
    linked = linked[linked != lead]
    return pd.DataFrame({"a": np.full(len(linked), lead, np.int64), "b": linked})


def verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the distinct pairs that are linked, on the whole sets. texts: (doc, z), texts compressed.

    A lead `a` meets its partners in groups of about GROUP, each with a copy of its text, so that a lead with
    very many partners is spread over tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("g"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("g")).alias("salt"))
    text = lambda name: texts.select(F.col("doc").alias(name), "z")
    partners = dealt.join(text("b"), "b").select("a", "salt", F.col("b").alias("doc"), "z")
    leads = dealt.select("a", "salt").distinct().join(text("a"), "a").select("a", "salt", F.col("a").alias("doc"), "z")
    return partners.unionByName(leads).groupBy("a", "salt").applyInPandas(lambda rows: compare(rows, percent), "a long, b long")


def compress(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, z): texts as zstandard frames, a third of what a shuffle would carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.compress(t) for t in _raw(batch.column(1))], pa.binary())], names=["doc", "z"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "doc long, z binary")


def similarity_classes(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the smallest key reachable by links, itself included.

    Two rows link when their sets of distinct WORDS-word shingles (fewer words: the whole sequence) have a
    Jaccard similarity of at least percent / 100. Null, empty and wordless texts have the empty set and no
    links. Keys are integers; each row is a document of its own, also where rows share a key. A row with a null
    key has no links and a null class. Other columns are not read.
    """
    told = stash(describe(text_batches(df), key, text).withColumn("row", F.monotonically_increasing_id()))
    sets = stash(told.select("doc", "n", "h1", "h2"))
    # equal sets are one class from here on; the text of its smallest document stands for it, called by its row number
    first = F.min(F.struct("doc", "row"))
    named = stash(told.where("n > 0 and doc is not null").groupBy("h1", "h2", "n").agg(first.alias("x")).select("h1", "h2", "n", "x.*"))
    texts = stash(told.join(named, "row", "left_semi").select(F.col("row").alias("doc"), "n", "x", "z"))
    discard(told)
    reps = texts.select("doc", "n", "x")
    total = texts.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // PART) + 1  # of about half as many keys as shingles
    dealt = deal_keys(texts, parts, percent, count_keys(texts, percent))
    met = stash(dealt.groupBy("part").applyInPandas(lambda rows: star_candidates(rows, percent), "key long, lead long, doc long, near boolean"))
    stars = met.where("near").select("lead", "doc").distinct()
    x, y = reps.alias("x"), reps.alias("y")
    stars = stars.alias("s").join(x, F.col("s.lead") == F.col("x.doc")).join(y, F.col("s.doc") == F.col("y.doc"))
    stars = stash(stars.where(_allowed("x", "y", percent)).select(F.col("s.lead").alias("a"), F.col("s.doc").alias("b")))
    linked = stash(verify(stars, texts, percent))
    group = stash(components(linked))
    known = met.where("key is not null")
    known = stash(known.select("key", "doc").unionByName(known.where("lead >= 0").select("key", F.col("lead").alias("doc"))).distinct())
    tested = stars
    for most in (*ROUNDS, 1 << 40):
        pairs = open_pairs(known, group, reps, percent, most)
        if pairs is None:
            break
        pairs = stash(pairs)
        fresh = stash(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            linked = linked.unionByName(stash(verify(fresh, texts, percent)))
            tested = tested.unionByName(fresh)
            group = stash(components(linked))
        if pairs.where("more").isEmpty():
            break
    discard(met, known, texts)
    # components by their smallest document instead of their smallest row
    group = group.unionByName(group.select(F.col("component").alias("id"), "component").distinct())
    of_row = group.join(named.select("row", F.col("doc").alias("rep")), F.col("id") == F.col("row"))
    least = of_row.groupBy("component").agg(F.min("rep").alias("component_id"))
    lead = of_row.join(least, "component").select("row", "component_id")
    classes = named.join(lead, "row", "left").select("h1", "h2", "n", F.coalesce("component_id", "doc").alias("component_id"))
    out = sets.join(classes, ["h1", "h2", "n"], "left")
    of_own = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component_id"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce(of_own, "doc").alias("component_id"))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(documents(spark, sf_dir))
