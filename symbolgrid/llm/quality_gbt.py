"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training works on a bounded sample of labelled documents: statistics are binned once by their
quantiles, and each level of a tree sums gradients per (node, statistic, bin). The fitted trees
are complete binary trees flattened into arrays (statistic, threshold, leaf value per node);
scoring walks all trees for all rows of a batch level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolgrid.llm.words import Words, filled, mix, pieces, tidy

#: Labelled documents that the trees are fitted on: those of smallest hash of doc_id.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 4, 80, 0.15, 1.0, 10.0
CUT = 0.3

_KINDS = {
    "symbol": b"#*$%&|<>",
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "shout": b"!?",
    "stop": b".,;:",
    "wide": bytes(range(0xC3, 0x100)),
    "quote": b"\"'()[]{}",
}
_KIND_OF = np.zeros((len(_KINDS), 256), dtype=bool)
for _i, _set in enumerate(_KINDS.values()):
    _KIND_OF[_i, list(_set)] = True
STATISTICS = [
    "log_words", "word_bytes", "word_bytes_spread", "distinct_share", "top_share", "repeat_next_share", "repeat_window_share",
    "short_share", "long_share", "lines_per_word", "dup_line_share", "line_start_upper", "capital_words", *_KINDS,
]


def _per_text(text: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct keys, count of the commonest key, keys that occur twice or more."""
    if not len(keys):
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, text))
    t, k = text[order], keys[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, len(t)))
    owner = t[begin]
    top = np.zeros(n)
    np.maximum.at(top, owner, run)
    return np.bincount(owner, minlength=n), top, np.bincount(owner, weights=np.where(run > 1, run, 0), minlength=n)


def statistics_of(texts: pa.Array) -> np.ndarray:
    """(texts, statistics); an empty text has zeros throughout."""
    w, n = Words(texts), len(texts)
    count = w.counts.astype(np.float64)
    some = np.maximum(count, 1)
    size = (w.stops - w.starts).astype(np.float64)
    total = np.bincount(w.text, weights=size, minlength=n)
    mean = total / some
    spread = np.sqrt(np.maximum(np.bincount(w.text, weights=size * size, minlength=n) / some - mean * mean, 0))
    distinct, top, _ = _per_text(w.text, w.hashes, n)
    same_next = (w.hashes[1:] == w.hashes[:-1]) & (w.text[1:] == w.text[:-1])
    at, windows = w.windows(5)
    _, _, again = _per_text(w.text[at] if len(at) else at, windows, n)
    breaks = w.data == 0x0A
    gap = np.cumsum(np.concatenate([[0], breaks]))
    lines = gap[w.offsets[1:]] - gap[w.offsets[:-1]] + (count > 0)
    # A line's words hash to one key: words of a line share the number of breaks before them.
    line_of = gap[w.starts] + w.text
    begin = np.flatnonzero(np.concatenate([[True], line_of[1:] != line_of[:-1]])) if len(line_of) else np.zeros(0, np.int64)
    line_key = np.add.reduceat(mix(w.hashes + np.arange(len(w.hashes), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(line_of)))).astype(np.uint64)), begin) if len(begin) else w.hashes[:0]
    line_text = w.text[begin]
    dup = np.bincount(line_text, minlength=n) - _per_text(line_text, line_key, n)[0]
    capital = _KIND_OF[1][w.data[w.starts]] if len(w.starts) else np.zeros(0, bool)
    full = np.bincount(w.text, weights=capital, minlength=n)
    first = np.bincount(line_text, weights=capital[begin], minlength=n)
    share = [np.bincount(w.text, weights=x, minlength=n) / some for x in (size <= 3, size >= 12)]
    sums = []
    for kind in _KIND_OF:
        run = np.concatenate([[0], np.cumsum(kind[w.data])])
        sums.append((run[w.offsets[1:]] - run[w.offsets[:-1]]) / np.maximum(total, 1))
    columns = [
        np.log1p(count), mean, spread, distinct / some, top / some, np.bincount(w.text[1:], weights=same_next, minlength=n) / some if len(same_next) else np.zeros(n),
        again / some, *share, lines / some, dup / np.maximum(lines, 1), first / np.maximum(lines, 1), full / some, *sums,
    ]
    return np.stack([np.asarray(c, dtype=np.float64) for c in columns], axis=1)


class Trees:
    """Flattened: node k of tree t has its children at 2k+1 and 2k+2; leaves hold values."""

    def __init__(self, statistic: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.statistic, self.threshold, self.value, self.start = statistic, threshold, value, start

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for statistic, threshold, value in zip(self.statistic, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, statistic[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Logistic loss. Without rows or with one class the score is the smoothed share of ones."""
    n, p = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    nodes = 2**DEPTH - 1
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, start)
    statistic, threshold, value = [], [], []
    column = np.arange(p) * BINS
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        grad, hess = prob - y, prob * (1 - prob)
        place = np.zeros(n, dtype=np.int64)
        stat, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, np.inf)
        for level in range(DEPTH):
            base, wide = 2**level - 1, 2**level
            keys = ((place - base)[:, None] * (p * BINS) + column[None, :] + binned).ravel()
            g = np.bincount(keys, weights=np.repeat(grad, p), minlength=wide * p * BINS).reshape(wide, p, BINS)
            h = np.bincount(keys, weights=np.repeat(hess, p), minlength=wide * p * BINS).reshape(wide, p, BINS)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
            gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = -np.inf
            best = gain.reshape(wide, -1).argmax(axis=1)
            for node, k in enumerate(best.tolist()):
                j, b = divmod(k, BINS)
                if gain[node, j, b] > 1e-6 and b < len(edges[j]):
                    stat[base + node], cut[base + node] = j, edges[j][b]
            place = 2 * place + 1 + (x[np.arange(n), stat[place]] > cut[place])
        leaf = place - nodes
        g = np.bincount(leaf, weights=grad, minlength=nodes + 1)
        h = np.bincount(leaf, weights=hess, minlength=nodes + 1)
        step = -RATE * g / (h + L2)
        raw += step[leaf]
        statistic.append(stat)
        threshold.append(cut)
        value.append(step)
    return Trees(np.array(statistic), np.array(threshold), np.array(value), start)


@tidy
def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            x = statistics_of(filled(part.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "x"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """From docs(doc_id, text) and labels(doc_id, label 0 or 1).

    Null labels teach nothing, of several labels of one document the smallest counts, and at
    most ``sample`` documents are used, so what reaches the driver is bounded.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy(F.col("doc_id").alias("known")).agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("known"), "known").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("known")).select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"), "text")
    # However often a labelled id is repeated, one row of it reaches the driver: that of smallest statistics.
    measured = rows.mapInArrow(_measure, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("least"))
    table = measured.select("doc_id", "least.*").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(table["x"].to_list()) if len(table) else np.zeros((0, len(STATISTICS)))
    return train(x, table["label"].to_numpy(dtype=np.float64))


def score(spark: SparkSession, docs: DataFrame, trees: Trees) -> DataFrame:
    """One row per input row: doc_id, score. Columns used: doc_id, text; null text is empty and
    is scored as such; a null doc_id stays null. Repeated rows and equal texts get equal scores;
    texts of any length are taken whole; an empty table gives no rows."""
    shared = spark.sparkContext.broadcast(trees)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                x = statistics_of(filled(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(x))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
