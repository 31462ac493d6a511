"""Spelling variants: words one edit apart, found by walking a trie and a Levenshtein automaton together.

The dictionary becomes tries of bounded size over ranges of its sorted words. They are broadcast, as many at a time as
a bound of bytes allows, and every word's automaton of distance one meets each of them. What a task finds is a count
and a best form for each word, never the list of pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, documents, shared_dir, stash

#: Words and letters of a trie at most (a word with more letters has one of its own), and bytes broadcast at once.
SHARD_WORDS, SHARD_LETTERS, ROUND_BYTES = 1 << 16, 1 << 20, 1 << 26
#: Words looked up by a task, and at once; states that one step of a walk takes from the stack.
TASK_WORDS, BLOCK_WORDS, STATES = 16_384, 2048, 1 << 18
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIE = "shard string, size long, labels binary, parents binary, ends binary, counts binary"


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points one after the other, where each word begins, lengths)."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), np.cumsum(length) - length, length


class Trie:
    """Nodes level by level, so that the children of a node are neighbours, in order of their letters.

    labels, parents: of each node; node 0 is the root. ends: which word ends at a node, -1 for none. counts: by word.
    """

    def __init__(self, labels: np.ndarray, parents: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        self.labels, self.parents, self.ends, self.counts = labels, parents, ends, counts
        self.keys = (parents[1:].astype(np.int64) << 21) | labels[1:]
        self.first = np.searchsorted(parents[1:], np.arange(len(parents) + 1)) + 1

    @classmethod
    def of(cls, words: list[str], counts: np.ndarray) -> Trie:
        """The trie of distinct words in code-point order."""
        flat, begin, length = letters(words)
        at, alive = np.zeros(len(words), dtype=np.int64), np.arange(len(words))
        labels, parents, ends, nodes, depth = [np.zeros(1, np.uint32)], [np.full(1, -1, np.int32)], [np.full(1, -1, np.int32)], 1, 0
        while len(alive := alive[length[alive] > depth]):
            letter, parent = flat[begin[alive] + depth], at[alive]
            new = np.append(True, (letter[1:] != letter[:-1]) | (parent[1:] != parent[:-1]))
            at[alive] = nodes - 1 + np.cumsum(new)
            depth += 1
            last, end = alive[length[alive] == depth], np.full(int(new.sum()), -1, np.int32)
            end[at[last] - nodes] = last
            labels, parents, ends = [*labels, letter[new]], [*parents, parent[new].astype(np.int32)], [*ends, end]
            nodes += len(end)
        return cls(np.concatenate(labels), np.concatenate(parents), np.concatenate(ends), np.asarray(counts, dtype=np.int64))

    def packed(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        parts = tuple(x.tobytes() for x in (self.labels, self.parents, self.ends, self.counts))
        return sum(map(len, parts)), *parts

    @classmethod
    def unpacked(cls, labels: bytes, parents: bytes, ends: bytes, counts: bytes) -> Trie:
        return cls(np.frombuffer(labels, np.uint32), np.frombuffer(parents, np.int32), np.frombuffer(ends, np.int32), np.frombuffer(counts, np.int64))

    def spelt(self, node: int) -> str:
        out = []
        while node:
            out.append(chr(self.labels[node]))
            node = self.parents[node]
        return "".join(reversed(out))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by its letter, 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(node), dtype=np.int64)
        key = (node << 21) | letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at + 1, 0)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of a word, node) of all words of the trie that differ from it by one letter put in, left out or replaced.

        A state is a word, how many of its letters are read, a node, and whether the edit is made. States wait on a
        stack, so those with the edit made go to their end first. A letter is put in before an unlike one or at the end,
        and left out at the end of a run of its like: each neighbour is reached in one way.
        """
        flat, begin, length = letters(words)
        flat = np.append(flat, np.uint32(0))  # a letter may be looked at after the last word
        n = len(words)
        stack = [(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool))]
        found = []
        while stack:
            state = stack.pop()
            if len(state[0]) > STATES:
                stack.append(tuple(x[STATES:] for x in state))
                state = tuple(x[:STATES] for x in state)
            w, i, node, made = state
            over = i == length[w]
            accepted = made & over
            accepted[accepted] = self.ends[node[accepted]] >= 0
            found.append((w[accepted], node[accepted]))
            letter = flat[begin[w] + i].astype(np.int64)
            to = np.where(over, 0, self.child(node, letter))
            on = to > 0
            free, done = on & ~made, on & made
            if free.any():
                stack.append((w[free], i[free] + 1, to[free], made[free]))
            # the edits, where none is made yet
            w1, i1, node1, over1, letter1 = (x[~made] for x in (w, i, node, over, letter))
            out = ~over1 & ((i1 + 1 == length[w1]) | (flat[np.minimum(begin[w1] + i1 + 1, len(flat) - 1)] != letter1))
            children = self.first[node1 + 1] - self.first[node1]
            owner = np.repeat(np.arange(len(w1)), children)
            kid = np.arange(len(owner)) - np.repeat(np.cumsum(children) - children, children) + self.first[node1][owner]
            unlike = over1[owner] | (self.labels[kid] != letter1[owner])
            owner, kid = owner[unlike], kid[unlike]
            instead = ~over1[owner]
            ws = [w[done], w1[out], w1[owner], w1[owner][instead]]
            at = [i[done] + 1, i1[out] + 1, i1[owner], i1[owner][instead] + 1]
            nodes = [to[done], node1[out], kid, kid[instead]]
            if sum(map(len, ws)):
                w = np.concatenate(ws)
                stack.append((w, np.concatenate(at), np.concatenate(nodes), np.ones(len(w), bool)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, times: int = 2, noise: int = 31) -> DataFrame:
    """(word, n) of the words of at least `least` code points that occur at least `times` times.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Where `noise` divides the crc32 of
    `<key>:<run>`, the run loses the code point crc32 % length; a null key counts as no characters, a null text as none.
    """
    run, drawn = F.col("run"), F.col("drawn")
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
    found = found.select("run", F.crc32(F.concat("key", F.lit(":"), run).cast("binary")).alias("drawn"))
    word = F.when(drawn % noise == 0, F.overlay(run, F.lit(""), (drawn % F.length(run)).cast("int") + 1, F.lit(1))).otherwise(run)
    return found.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def tries(words: DataFrame, count: int) -> DataFrame:
    """Tries of the words (word, n), which are distinct, a row for each: ranges of words in order, cut again by size."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int]] = []
        size = 0

        def close() -> pd.DataFrame:
            row = (uuid.uuid4().hex, *Trie.of([w for w, _ in held], np.array([n for _, n in held])).packed())
            held.clear()
            return pd.DataFrame([row], columns=["shard", "size", "labels", "parents", "ends", "counts"])

        for batch in batches:
            for w, n in zip(batch["word"], batch["n"], strict=True):
                if held and (len(held) == SHARD_WORDS or size + len(w) > SHARD_LETTERS):
                    yield close()
                    size = 0
                held.append((w, n))
                size += len(w)
        if held:
            yield close()

    parts = max(1, -(-count // SHARD_WORDS))
    return words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInPandas(build, TRIE)


def rounds(sizes: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Shards in groups of at most `most` bytes, or one shard."""
    held, total = [], 0
    for shard, size in sorted(sizes):
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(shard)
        total += size
    if held:
        yield held


def neighbours(words: DataFrame, count: int, most: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near word: how many, the largest n among them and the
    smallest word that has it. `most`: bytes of tries that driver and tasks hold at once."""
    spark = words.sparkSession
    path = f"{shared_dir(spark)}/near-{uuid.uuid4().hex}"
    shards = stash(tries(words, count))
    asked = words.select("word").repartition(max(1, -(-count // TASK_WORDS)), "word")
    schema = "word string, n_near long, best_n long, best string"
    spark.createDataFrame([], schema).write.parquet(path)
    for group in rounds([tuple(r) for r in shards.select("shard", "size").collect()], most):
        held = shards.where(F.col("shard").isin(group)).select("labels", "parents", "ends", "counts").collect()  # at most `most` bytes
        sent = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in held])

        def look_up(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = [Trie.unpacked(*x) for x in sent.value]
            for batch in batches:
                for lo in range(0, len(batch), BLOCK_WORDS):
                    block = batch["word"].iloc[lo : lo + BLOCK_WORDS].tolist()
                    rows = []
                    for trie in own:
                        w, node = trie.near(block)
                        end = trie.ends[node]
                        order = np.lexsort((end, -trie.counts[end], w))  # words end in code-point order
                        w, node, end = w[order], node[order], end[order]
                        first = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
                        near = np.diff(np.append(first, len(w)))
                        rows += [(block[x], int(k), int(trie.counts[e]), trie.spelt(b)) for x, k, e, b in zip(w[first], near, end[first], node[first], strict=True)]
                    yield pd.DataFrame(rows, columns=["word", "n_near", "best_n", "best"])

        asked.mapInPandas(look_up, schema).write.mode("append").parquet(path)
        sent.destroy()
    discard(shards)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    found = spark.read.schema(schema).parquet(path).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends. Steps double in each round. A chain of forms ends, as n grows
    along it."""
    at = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(at)
        at = step
        if step.where("moved").isEmpty():
            return step.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    Two words are near if one edit of a code point makes one of the other. A word's form is its near word of largest n, of
    those the first in code-point order, if that n is at least ratio (above 1) times its own; root is where forms lead, the
    word itself without one. Null and empty words are left out; an empty table gives an empty one.
    """
    words = stash(words.select("word", F.col("n").cast("long").alias("n")).where("word <> ''"))
    near = neighbours(words, words.count())
    found = words.join(near, "word", "left")
    has = F.col("best_n") >= F.col("n") * ratio
    found = stash(found.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    out = found.join(roots(found.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(documents(spark, sf_dir)))
