"""Language identification of whole texts, with the spans of mixed-language ones.

Training counts words and character n-grams per language in Spark on a bounded sample of labelled rows.
A text is cut into words; the script of a word narrows the languages that may have written it, each
language scores the word, and a Viterbi pass with a penalty for switching labels the words. The language
with most letters names the text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bytestext import runs
from .common import documents, prefix, text_batches

#: Labelled texts used for training, of each language, chosen by a hash of the text.
SAMPLE_ROWS = 1000
#: Languages learned, those with most texts.
MOST_LANGS = 500
#: Words and n-grams kept per language; the model's size follows from these and the number of languages.
TOP_WORDS, TOP_GRAMS = 20_000, 20_000
#: Log-probability lost when the language changes between two words, and for another script than a language's.
SWITCH, WRONG_SCRIPT = 8.0, 50.0
#: Share of a language's words from which on it writes a script.
LEAST_SHARE = 0.001
#: First code points of script ranges, each up to the next. Fixed values.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x323B0, "other"),
]
_FROM = np.array([a for a, _ in SCRIPTS])
LETTERS = re.compile(r"[^\W\d_]+")
#: Entries of the word cache in a worker; it is emptied when full, which changes no result.
CACHE = 200_000
#: Characters labelled at once; texts advance together, so long slices mean few steps.
SLICE = 1_000_000


SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_ID = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def scripts_of(words: list[str]) -> np.ndarray:
    """Number of the script (in SCRIPT_NAMES) that a word's first letter is in."""
    first = np.frombuffer("".join(w[0] for w in words).encode("utf-32-le"), np.uint32)
    return _SCRIPT_ID[np.searchsorted(_FROM, first, "right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character n-grams of 1 to 3 of words with their ends marked, as numbers: (gram, word it is in).

    Ends are U+0001 and U+0002; alone they are no gram."""
    text = "".join(f"\1{w}\2" for w in words)
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    found, of = [c[c > 2]], [owner[c > 2]]
    for n in (2, 3):
        key = np.zeros(len(c) - n + 1, np.int64)
        for k in range(n):
            key = key << 21 | c[k : len(c) - n + 1 + k]
        whole = owner[: len(key)] == owner[n - 1 :]
        found.append(key[whole])
        of.append(owner[: len(key)][whole])
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Model:
    """Log-probabilities per language of words and n-grams (sorted; the last row is for unseen ones), and
    which languages write each script (all, where none does)."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: np.ndarray
    gram_logs: np.ndarray
    scripts: np.ndarray

    def score(self, words: list[str]) -> np.ndarray:
        """words x languages: the word's log-probability where it is known, else the mean of its n-grams,
        scaled for up to 6 of them; both against the mean over languages, so that no word outweighs all others."""
        known = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out = self.word_logs[known] if len(self.words) else np.zeros((len(words), len(self.langs)))
        new = np.flatnonzero(known < 0)
        if len(new):
            g, of = grams([words[i] for i in new])
            at = np.minimum(np.searchsorted(self.grams, g), max(0, len(self.grams) - 1))
            at = np.where(self.grams[at] == g, at, len(self.grams)) if len(self.grams) else np.zeros(len(g), np.int64)
            n = np.bincount(of, minlength=len(new))
            total = np.stack([np.bincount(of, weights=self.gram_logs[at, k], minlength=len(new)) for k in range(len(self.langs))], axis=1)
            out[new] = total / n[:, None] * (np.minimum(n, 6) / 2)[:, None]
        out = out - out.mean(1, keepdims=True)
        return np.where(self.scripts[scripts_of(words)], out, out - WRONG_SCRIPT).astype(np.float32)


def labelled_words(rows: DataFrame, text: str, lang: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))
    return rows.select(F.col(lang).alias("lang"), F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit a model on rows with a text and one of the MOST_LANGS most frequent languages. The sample is the distinct texts whose hash is in the
    first part of the hash range, the part set for each language so that about sample_rows are in it."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("_h"))
    text, lang = "text", "lang"
    counts = rows.groupBy(lang).agg(F.approx_count_distinct("_h").alias("n"))
    many = {r[0]: r[1] for r in counts.orderBy(F.desc("n"), lang).limit(MOST_LANGS).collect()}
    langs = sorted(many)
    if not langs:
        return fit([], pd.DataFrame({"lang": [], "word": [], "n": []}))
    ends = [F.lit(y) for x, n in many.items() for y in (x, min((1 << 63) - 1, int(sample_rows / max(1, n) * (1 << 63))))]
    kept = rows.where(F.col("_h") <= F.try_element_at(F.create_map(*ends), F.col(lang)))  # MOST_LANGS entries at most
    words = labelled_words(kept.dropDuplicates([lang, "_h"]), text, lang)
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = words.withColumn("i", F.row_number().over(rank)).where(F.col("i") <= TOP_WORDS).select("lang", "word", "n").toPandas()
    return fit(langs, top)


def fit(langs: list[str], counts: pd.DataFrame) -> Model:
    """counts: lang, word, n; at most TOP_WORDS rows for each language."""
    words = counts["word"].to_list()
    lang = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    n = counts["n"].to_numpy(dtype=float)

    def table(keys: np.ndarray, by: np.ndarray, weight: np.ndarray, most: int, least: float):
        """Keys that are among the `most` frequent of a language, with their logs; logs of unseen ones last."""
        names, at = np.unique(keys, return_inverse=True)
        count = np.zeros((len(names), len(langs)))
        np.add.at(count, (at, by), weight)
        kept = np.zeros(len(names), bool)
        for k in range(len(langs)):
            top = np.lexsort((np.arange(len(names)), -count[:, k]))[:most]
            kept[top[count[top, k] >= least]] = True
        total = count.sum(0) + kept.sum() + 1
        return names[kept], np.log((np.vstack([count[kept], np.zeros((1, len(langs)))]) + 0.5) / total)

    names, word_logs = table(np.array(words, dtype=object), lang, n, TOP_WORDS, 5) if words else ([], np.zeros((1, len(langs))))
    g, of = grams(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys, gram_logs = table(g, lang[of], n[of], TOP_GRAMS, 2)
    written = np.zeros((len(SCRIPT_NAMES), len(langs)))
    if words:
        np.add.at(written, (scripts_of(words), lang), n)
        written = written / written.sum(0)
    writes = written >= LEAST_SHARE
    writes[~writes.any(1)] = True
    return Model(langs, {w: i for i, w in enumerate(names)}, word_logs, keys, gram_logs, writes)


def viterbi(scores: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of every word. scores: words x languages, texts one after the other; ends: end of each text.

    All texts advance together, a word at a time, so the work for a step is a few array operations.
    """
    n, k = scores.shape
    starts = np.concatenate([[0], ends[:-1]])
    order = np.argsort(starts - ends, kind="stable")  # longest first
    starts, length = starts[order], (ends - starts)[order]
    alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    stay, came = np.ones((n, k), bool), np.zeros(n, np.int16)
    best = np.zeros((len(starts), k))
    for t, m in enumerate(alive):
        row = starts[:m] + t
        if t:
            b = best[:m]
            top = b.argmax(1)
            jump = b[np.arange(m), top] - switch
            stay[row] = b >= jump[:, None]
            came[row] = top
            best[:m] = np.maximum(b, jump[:, None])
        best[:m] += scores[row]
    labels = np.zeros(n, np.int16)
    now = best.argmax(1).astype(np.int16)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        row = starts[:m] + t
        labels[row] = now[:m]
        if t:
            now[:m] = np.where(stay[row, now[:m]], now[:m], came[row])
    return labels


class Labeller:
    """Labels the words of texts, keeping the scores of words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end of each text, letters of each word, label of each word)."""
        words = [lower_words(t) for t in texts]
        flat = list(itertools.chain.from_iterable(words))
        if len(self.place) > CACHE:
            self.clear()
        new = list(set(flat) - self.place.keys())
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.score(new)])
        ids = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([len(w) for w in words])
        size = np.fromiter(map(len, flat), np.int64, len(flat))
        return ends, size, viterbi(self.scores[ids], ends) if len(ids) else np.zeros(0, np.int16)


def lower_words(text: str) -> list[str]:
    """Lower-cased words, as many as there are in the text itself."""
    low = text.lower()
    return LETTERS.findall(low) if len(low) == len(text) else [w.lower() for w in LETTERS.findall(text)]


def detect(df: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """df with lang_pred, score (share of the text's letters in that language), n_spans and, if asked for,
    spans: array of (start, end, lang), characters of maximal runs of words of one language.

    A text that is null or has no letter is `und` with score 0 and no spans. Equal shares: the smaller
    language name. Only the text is read; columns with the names of results are replaced, all others stay. With a
    model of no languages every text is `und`; an empty table gives an empty one.
    """
    df = text_batches(df).drop("lang_pred", "score", "n_spans", "spans")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.IntegerType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by TOP_WORDS, TOP_GRAMS and the languages

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        names = np.array(shared.value.langs, dtype=object)
        for s in batches:
            whole = ["" if t is None else t for t in s]
            out = []
            for a, b in runs(list(map(len, whole)), SLICE):
                texts = whole[a:b] if len(names) else [""] * (b - a)
                ends, sizes, labels = labeller.label(texts)
                begin = 0
                for text_, end in zip(texts, ends, strict=True):
                    lab, size = labels[begin:end], sizes[begin:end]
                    begin = end
                    if not len(lab) or not any(map(str.isalpha, text_)):
                        out.append(("und", 0.0, 0, []) if spans else ("und", 0.0, 0))
                        continue
                    letters = np.bincount(lab, weights=size, minlength=len(names))
                    top = int(letters.argmax())
                    turn = np.flatnonzero(np.diff(lab)) + 1
                    row = (names[top], float(letters[top] / letters.sum()), len(turn) + 1)
                    if spans:
                        at = [x.span() for x in LETTERS.finditer(text_)]
                        cuts = [0, *turn.tolist(), len(lab)]
                        row += ([(at[i][0], at[j - 1][1], names[lab[i]]) for i, j in itertools.pairwise(cuts)],)
                    out.append(row)
            yield pd.DataFrame(out, columns=[f.name for f in fields])

    udf = F.pandas_udf(run, T.StructType(fields))
    made = prefix(df)
    out = df.withColumn(made, udf(F.col(text)))
    return out.select(*df.columns, *[F.col(made)[f.name].alias(f.name) for f in fields])


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame) -> Model:
    return train(docs.where(~held_out() | F.col("doc_id").isNull()))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    found = detect(d.select("doc_id", "text"), trained(d))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_spans")
