"""Substring removal and near-duplicates against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from symbolgrid.llm import neardup, substring
from symbolgrid.llm.words import Words

from .conftest import AWKWARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_removed(rows, length=35):
    words = [WORD.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[k : k + length]) for w in words for k in range(len(w) - length + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (34, 35, 36, 60, 150)]
    rows = [(k, prose(rng, rng.randrange(0, 120)) + " " + rng.choice(shared) + "\n" + prose(rng, rng.randrange(0, 80))) for k in range(10, 90)]
    rows += [(100 + k, prose(random.Random(5), 90)) for k in range(30)]  # exact copies
    rows += [(200, "a b " * 300), (201, "a b c " * 80 + prose(rng, 50)), (202, "z " * 36), (203, "z " * 34)]
    return rows + AWKWARD


@pytest.mark.parametrize(("crowd", "shard"), [(500, 60_000), (2, 500), (1, 60_000)])
def test_substring_equals_brute_force(spark, documents, monkeypatch, crowd, shard):
    monkeypatch.setattr(substring, "CROWD", crowd)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rows = passages(1)
    got = substring.remove_repeats(spark, documents(rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=str) == brute_removed(rows)


def test_substring_of_a_very_common_passage(spark, documents, monkeypatch):
    """One minimizer with very many distinct spans: the borders of a passage that most texts share."""
    monkeypatch.setattr(substring, "CROWD", 20)
    rng = random.Random(11)
    shared = [prose(rng, n, 5000) for n in (36, 44, 70)]
    rows = [(k, prose(rng, rng.randrange(0, 9), 5000) + " " + shared[k % 3] + " " + prose(rng, rng.randrange(0, 9), 5000)) for k in range(2500)]
    rows += [(9000, " ".join(shared) + " " + prose(rng, 20_000, 5000))]
    got = substring.remove_repeats(spark, documents(rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=str) == brute_removed(rows)


def test_substring_of_nothing(spark, documents):
    assert substring.remove_repeats(spark, documents([])).collect() == []


def test_automaton_counts():
    rng = random.Random(2)
    strings = [([rng.randrange(3) for _ in range(rng.randrange(1, 25))], rng.randrange(1, 3)) for _ in range(12)]
    a = substring.SuffixAutomaton()
    for s, n in strings:
        a.add(s, n)
    a.finish()
    count = collections.Counter()
    for s, n in strings:
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                count[tuple(s[i:j])] += n
    for s, _ in strings:
        for end, size in enumerate(a.matching_statistics(s), 1):
            assert size == max((k for k in range(end + 1) if k == 0 or count[tuple(s[end - k : end])] >= 2), default=0)


def test_word_hashes():
    texts = pa.array(["The  cat\tsat", "cat", "", "THE", None and "" or "sat the cat"])
    w = Words(texts, lower=True)
    assert w.counts.tolist() == [3, 1, 0, 1, 3]
    by = dict(zip(["the", "cat", "sat"], w.hashes[:3].tolist(), strict=True))
    assert w.hashes.tolist() == [by[x] for x in "the cat sat cat the sat the cat".split()]


def brute_components(rows):
    """(doc_id, set size, component_id, kept) of every row; texts of one set are one node."""

    def shingles(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    nodes = sorted({s for s in sets if s}, key=sorted)
    root = {s: s for s in nodes}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for x, a in enumerate(nodes):
        for b in nodes[x + 1 :]:
            if 100 * len(a & b) >= 75 * len(a | b):
                root[find(b)] = find(a)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        top = least.get(find(s)) if s else i
        out.append((i, len(s), top, i == top))
    return sorted(out, key=str)


def near_copies(seed):
    rng = random.Random(seed)
    rows, k = [], 10
    for _ in range(12):
        base = prose(rng, rng.randrange(6, 200)).split(" ")
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 14))):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            text = " ".join(copy)
            rows.append((k, text.upper() if rng.random() < 0.2 else text))
            k += 1
    rows += [(500 + i, "a b c d") for i in range(3)] + [(510, "a b c"), (511, "A  b\nc")]
    # One id with two texts of its own; a copy without an id; a text of many thousand words.
    rows += [(520, prose(random.Random(7), 60)), (520, prose(random.Random(8), 60)), (521, prose(random.Random(8), 60)), (None, rows[3][1])]
    long_ = prose(random.Random(9), 30_000, 5000)
    rows += [(530, long_), (531, long_ + " end")]
    return rows + AWKWARD


def common_passage(seed):
    """Texts that share a passage too short to link them, beside near copies of one text."""
    rng = random.Random(seed)
    passage, base = prose(rng, 40), prose(rng, 60).split(" ")
    rows = [(k, passage + " " + prose(rng, rng.randrange(8, 40))) for k in range(150)]
    for k in range(150, 300):
        copy = list(base)
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(60)] = f"edit{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("make", "seed", "block", "weight"), [(near_copies, 1, 7, 600), (near_copies, 2, 512, 1 << 19), (common_passage, 3, 16, 1 << 19), (common_passage, 4, 40, 900)])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, make, seed, block, weight):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "WEIGHT", weight)
    monkeypatch.setattr(neardup, "PAIRS_PER_TASK", 3)
    monkeypatch.setattr(neardup, "SLICE", 50)
    rows = make(seed)
    got = neardup.near_duplicates(spark, documents(rows)).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == brute_components(rows)


def test_near_duplicates_without_ids(spark, documents):
    text = prose(random.Random(3), 30)
    rows = [(None, text), (None, text), (None, text + " more"), (None, ""), (None, prose(random.Random(4), 30))]
    got = neardup.near_duplicates(spark, documents(rows)).collect()
    assert all(r.component_id is None for r in got)
    assert sorted((r.n_shingles, r.kept) for r in got if r.n_shingles in (0, 27)) in ([(0, True), (27, False)], [(0, True), (27, True)])
    assert len({r.component for r in got if r.kept and r.n_shingles}) == 2


def test_near_duplicates_of_nothing(spark, documents):
    assert neardup.near_duplicates(spark, documents([])).collect() == []


def test_pruning_keeps_what_is_similar():
    least = neardup.keep_counts()
    assert (np.diff(least) > 0).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (4000, neardup.HASHES), dtype=np.uint32)
    same, row = rng.random(a.shape) < 0.75, np.arange(len(a))
    b = np.where(same, a, a ^ np.uint32(1))
    assert len(neardup.bayes_survivors(a, b, row, row)) == len(a)
    assert len(neardup.bayes_survivors(a, rng.integers(0, 2**32, a.shape, dtype=np.uint32), row, row)) == 0


def test_component_of_a_chain(spark):
    from symbolgrid.llm.durable import Store

    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.label for r in neardup.components(Store(spark, "chain"), links, "x").collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_kept_text_digest(spark, documents):
    rows = [(1, "  a\tb  c ")]
    got = substring.remove_repeats(spark, documents(rows)).first()
    assert hashlib.sha256(got.kept_text.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()
