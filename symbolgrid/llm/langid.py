"""Language identification of mixed-language text.

Letters are grouped to words. Unicode script ranges narrow each word's candidate languages to
those that use its script; character n-gram scores rate the candidates; Viterbi with a switching
penalty then labels every word of a text, and equal neighbours join to spans. All texts of a batch
go through the Viterbi steps together, so a step is a few array operations, not a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolgrid.llm.words import filled, pieces, tidy

#: First and last code point of ranges, and the script they belong to.
SCRIPTS = [
    (0x0041, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"),
    (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"),
    (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
NAMES = ["other", *dict.fromkeys(name for _, _, name in SCRIPTS)]
#: Documents of each language that the model is fitted on: a bounded sample, by hash of doc_id.
SAMPLE = 1500
SLOTS = 1 << 16
SWITCH = 14.0
#: A language uses a script if at least this share of its sampled letters are in it.
SCRIPT_SHARE = 0.005
#: Score of a language that does not use the script of a word.
BARRED = -60.0
UNDETERMINED = "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point of the basic plane: letter or not, its lower case, its script."""
    points = [chr(i) for i in range(0x10000)]
    letter = np.array([category(c)[0] == "L" for c in points])
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(points)], dtype=np.uint32)
    script = np.zeros(0x10000, dtype=np.uint8)
    for first, last, name in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return letter, lower, script


class LetterWords:
    """Runs of letters of some texts: characters, word bounds, n-gram slots and scripts."""

    def __init__(self, texts: pa.Array):
        letter, lower, script = _tables()
        lists = texts.to_pylist()
        joined = np.frombuffer("\n".join(lists).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(t) + 1 for t in lists], dtype=np.int64)
        ends = np.cumsum(sizes)
        basic = np.minimum(joined, 0xFFFF)
        solid = letter[basic]
        high = np.flatnonzero(joined > 0xFFFF)
        if len(high):
            solid[high] = [category(chr(c))[0] == "L" for c in joined[high]]
        padded = np.concatenate([[False], solid, [False]])
        at = np.flatnonzero(padded[1:] != padded[:-1])
        self.starts, self.stops = at[0::2], at[1::2]
        self.first = np.searchsorted(self.starts, np.concatenate([[0], ends]))
        self.counts = np.diff(self.first)
        self.letters = self.stops - self.starts
        self.script = script[basic[self.starts]]
        where = np.flatnonzero(solid)
        self.begin = np.concatenate([[0], np.cumsum(self.letters)])[:-1]  # of each word among the letters
        chars = lower[basic[where]].astype(np.uint64)
        before = np.empty_like(chars)
        after = np.empty_like(chars)
        before[1:], after[:-1] = chars[:-1], chars[1:]
        before[self.begin] = 1
        after[self.begin + self.letters - 1] = 2
        shift = np.uint64(48)
        pair = (chars * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
        triple = (pair ^ (before * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
        self.pairs, self.triples = (pair >> shift).astype(np.int64), (triple >> shift).astype(np.int64)


class Model:
    """Log probabilities of n-gram slots per language and the scripts that each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        rate = (counts + 0.05) / (counts.sum(axis=2, keepdims=True) + 0.05 * SLOTS)  # (languages, 2, SLOTS)
        self.scores = np.log(rate).astype(np.float32).transpose(1, 2, 0).copy() if languages else np.zeros((2, SLOTS, 0), np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        uses = share >= SCRIPT_SHARE  # (languages, scripts)
        unknown = ~uses.any(axis=0)
        self.barred = np.where(uses | unknown, 0.0, BARRED).astype(np.float32).T.copy()  # (scripts, languages)

    def word_scores(self, words: LetterWords) -> np.ndarray:
        """(words, languages): mean of pair and triple log probabilities over the letters, summed."""
        per_letter = 0.5 * (self.scores[0][words.pairs] + self.scores[1][words.triples])
        return np.add.reduceat(per_letter, words.begin, axis=0) + self.barred[words.script]


def viterbi(scores: np.ndarray, first: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language index of every word. Texts are rows first[i] .. first[i] + counts[i] of scores."""
    n, k = scores.shape
    labels = np.zeros(n, dtype=np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order) or k < 2:
        return labels
    base, sizes = first[order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts longer than t
    value = scores[base].astype(np.float64)
    best = np.zeros(n, dtype=np.int64)
    stays = np.ones((n, k), dtype=bool)
    rows = np.arange(len(order))
    for t in range(1, sizes[0]):
        m = active[t]
        now, old = base[:m] + t, value[:m]
        top = old.argmax(axis=1)
        moved = (old[rows[:m], top] - switch)[:, None]
        stays[now] = old >= moved
        best[now] = top
        np.maximum(old, moved, out=old)
        old += scores[now]
    state = value.argmax(axis=1)
    for t in range(sizes[0] - 1, -1, -1):
        m = active[t]
        now, here = base[:m] + t, state[:m]
        labels[now] = here
        state[:m] = np.where(stays[now, here], here, best[now])
    return labels


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))


def label_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language, score and word spans (start, stop, lang; counted in letter words) of every text."""
    words, n = LetterWords(texts), len(texts)
    if not len(words.starts) or not model.languages:
        return [UNDETERMINED] * n, np.zeros(n), pa.array([[]] * n, _SPAN)
    labels = viterbi(model.word_scores(words), words.first[:-1], words.counts)
    text = np.repeat(np.arange(n), words.counts)
    k = len(model.languages)
    mass = np.bincount(text * k + labels, weights=words.letters, minlength=n * k).reshape(n, k)
    total = mass.sum(axis=1)
    winner = mass.argmax(axis=1)
    score = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
    langs = [model.languages[w] if t > 0 else UNDETERMINED for w, t in zip(winner.tolist(), total.tolist(), strict=True)]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (labels[1:] != labels[:-1])
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(text))
    base = words.first[text[begin]]
    names = pa.DictionaryArray.from_arrays(pa.array(labels[begin].astype(np.int32)), pa.array(model.languages, pa.string())).cast(pa.string())
    flat = pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((stop - base).astype(np.int32)), names], names=["start", "stop", "lang"])
    offsets = np.searchsorted(text[begin], np.arange(n + 1)).astype(np.int32)
    return langs, score, pa.ListArray.from_arrays(pa.array(offsets), flat)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n): n-gram slots as 0 .. 2 * SLOTS, scripts behind them."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "text"):
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs.tolist()):
                words = LetterWords(filled(part.column("text").filter(pa.array(langs == lang))))
                here = total.setdefault(lang, np.zeros(2 * SLOTS + len(NAMES), dtype=np.int64))
                here[:SLOTS] += np.bincount(words.pairs, minlength=SLOTS)
                here[SLOTS : 2 * SLOTS] += np.bincount(words.triples, minlength=SLOTS)
                here[2 * SLOTS :] += np.bincount(words.script, weights=words.letters, minlength=len(NAMES)).astype(np.int64)
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "slot", "n"])


def fit(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From docs(doc_id, text, lang): rows with a null lang or text teach nothing. At most
    ``sample`` ids a language, those of smallest hash; what reaches the driver is bounded by the
    slots. No rows give a model of no languages."""
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    rows = docs.select(F.col("doc_id").alias("taught"), F.col("lang").alias("taught_lang"), place.alias("place")).filter("lang is not null and text is not null")
    # Twice the share that would do, so that no task orders the documents of a common language. What
    # is broadcast has a row a language, as the model itself.
    share = rows.groupBy(F.col("taught_lang").alias("some_lang")).agg((2.0 * sample / F.count(F.lit(1))).alias("share"))
    near = rows.join(F.broadcast(share), (F.col("taught_lang") == F.col("some_lang")) & (F.col("place") <= F.col("share"))).select("taught", "taught_lang", "place").distinct()
    order = Window.partitionBy("taught_lang").orderBy("place", "taught")
    chosen = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("taught", "taught_lang")
    same = docs["doc_id"].eqNullSafe(F.col("taught")) & (docs["lang"] == F.col("taught_lang"))
    picked = docs.join(F.broadcast(chosen), same, "left_semi").select("lang", "text")  # at most ``sample`` rows a language
    table = picked.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    counts = np.zeros((len(languages), 2 * SLOTS + len(NAMES)))
    counts[table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), table["slot"].to_numpy(dtype=np.int64)] = table["n"]
    return Model(languages, counts[:, : 2 * SLOTS].reshape(-1, 2, SLOTS), counts[:, 2 * SLOTS :])


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, spans.

    Columns used: doc_id, text; others are ignored. Repeated rows are labelled alike, each on its
    own; texts of any length are taken whole; an empty table gives no rows. ``lang_pred`` has the most letters of the
    text (ties: the language first in order) and ``score`` is their share. Null texts and texts
    without a letter are ``und`` with score 0, as is everything under a model of no languages.
    """
    shared = spark.sparkContext.broadcast(model)  # two tables of SLOTS rows for each language

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):  # a step of Viterbi costs the same for few texts as for many
                langs, score, spans = label_texts(shared.value, filled(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs), pa.array(score), spans.cast(_SPAN)], names=["doc_id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>")
