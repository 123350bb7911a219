"""Search, mixing, and the pipeline."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from symbolgrid.llm import imi, mixing, neardup, outliers, queries, secret_ledger

from .conftest import AWKWARD, prose


def brute_search(rows, k=10, every=100):
    good = {}
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v]
    usable = [(i, v) for i, v in usable if len(v) == 8 and np.isfinite(v).all() and v.any()]
    for i, v in usable:
        if i % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in usable if j != i)[:k]
            good[i] = [(r + 1, j, s) for r, (s, j) in enumerate(found)]
    return good


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(300)]  # one very common vector, some of it asked for
    rows += [(5000, None), (5100, []), (5200, [0.0] * 8), (5300, [float("nan")] + [1.0] * 7), (5400, [float("inf")] + [1.0] * 7), (5500, [None] + [1.0] * 7), (5600, [1.0] * 3), (None, [1.0] * 8)]
    return rows


@pytest.mark.parametrize("chunk", [4096, 40])
def test_search_over_all_cells_is_exact(spark, monkeypatch, chunk):
    monkeypatch.setattr(imi, "CHUNK", chunk)
    monkeypatch.setattr(imi, "VISITS", 2)
    rows = vectors(700)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell string, chunk int")
    got = {}
    for r in imi.search_table(spark, df, probe=10**6).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute_search(rows)
    assert {q: [x[:2] for x in sorted(v)] for q, v in got.items()} == {q: [x[:2] for x in v] for q, v in want.items()}
    for q, v in want.items():
        assert np.allclose([x[2] for x in sorted(got[q])], [x[2] for x in v], rtol=1e-12, atol=0)


def test_search_when_a_query_id_is_repeated(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1, 60)]
    common = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(100, common)] * 15 + [(201, common)] * 3 + [(202, common)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r.vec_id for r in imi.search_table(spark, df, probe=10**6).orderBy("rank").collect()]
    assert got == [j for _, j, _ in brute_search(rows)[100]]
    assert got[:4] == [201, 201, 201, 202]


@pytest.mark.parametrize("clusters", [30, 0])
def test_search_recall(spark, clusters):
    """At the registered setting, on far more vectors than the first walk looks at."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 3 * bool(clusters)
    points = np.array([centres[i % 30] + rng.normal(size=8) for i in range(6000)]).astype(np.float32)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_search(rows)
    hits = sum(r.vec_id in {j for _, j, _ in want[r.query_id]} for r in imi.search_table(spark, df).collect())
    assert hits >= 0.9 * 10 * len(want)
    # What is visited within the true bound: little of clustered vectors.
    index = imi.Index(spark, df)
    visited = [sum(index.cell_sizes[c] for c, mean, spread in index.books.walk(points[q].astype(float)) if mean - spread**0.5 <= found[-1][2] ** 2) for q, found in want.items()]
    assert not clusters or np.mean(visited) < 0.25 * len(rows)


def test_search_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert imi.search_table(spark, spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)
    assert [(r.query_id, r.rank, r.vec_id) for r in imi.search_table(spark, few).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    single = spark.createDataFrame([(0, [3.0]), (7, [4.0])], schema)
    assert [(r.vec_id, r.score) for r in imi.search_table(spark, single).collect()] == [(7, 1.0)]


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(3)
    books = imi.Codebooks(rng.normal(size=(6, 4)), rng.normal(size=(5, 4)), rng.normal(size=(500, 8)))
    q = rng.normal(size=8)
    walked = list(books.walk(q))
    cells = [c for c, _, _ in walked]
    a, b = (((c - x) ** 2).sum(axis=1) for c, x in ((books.first, q[:4]), (books.second, q[4:])))
    distance = [a[c // 5] + books.loose[0][c // 5] + b[c % 5] + books.loose[1][c % 5] for c in cells]
    assert np.allclose(distance, [m for _, m, _ in walked])
    assert max(v for _, _, v in walked) ** 0.5 <= books.widest(q) + 1e-9
    assert sorted(cells) == list(range(30))
    assert np.allclose(distance, sorted(distance))


# -- mixing -----------------------------------------------------------------------------------------


def mix_rows(seed=4):
    rng = random.Random(seed)
    return [(100 + k, prose(rng, rng.randrange(5, 120)), rng.choice(["en", "en", "en", "fr", "de"]), rng.choice(["a", "a", "a", "b", "c"])) for k in range(600)]


def test_raking_equals_numpy(spark, documents):
    rows = mix_rows()
    target = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"en": 0.5, "fr": 0.25, "de": 0.25}, "topic": {f"t{i}": 0.125 for i in range(8)}}
    got = mixing.sample(spark, documents(rows), targets=target, budget=0.5).collect()
    assert len(got) == len(rows)
    cells = {}
    for r in got:
        cells.setdefault((r.source, r.lang, r.topic), [0, r.probability])[0] += r.tokens
        assert r.probability == pytest.approx(cells[(r.source, r.lang, r.topic)][1])
    weight = {c: float(n) for c, (n, _) in cells.items()}
    for _ in range(60):
        for at, key in enumerate(mixing.KEYS):
            for value, share in target[key].items():
                inside = sum(w for c, w in weight.items() if c[at] == value)
                for c in weight:
                    if c[at] == value and inside:
                        weight[c] *= share / inside
    total = sum(n for n, _ in cells.values())
    ratio = {c: cells[c][1] * cells[c][0] / weight[c] for c in weight if cells[c][1] < 1}
    assert max(ratio.values()) / min(ratio.values()) == pytest.approx(1, abs=0.01)  # probabilities follow the raked weights
    expected = sum(n * p for n, p in cells.values()) / total
    assert 0.48 <= expected <= 0.5
    assert sum(r.tokens for r in got if r.selected) / total == pytest.approx(0.5, abs=0.08)


def test_topics_follow_the_words(spark, documents):
    """Texts of one vocabulary are of one topic, in every language; a topic is not a language."""
    rng = random.Random(9)
    themes = [[f"theme{t}word{k}" for k in range(60)] for t in range(4)]
    rows = []
    for k in range(800):
        lang, theme = rng.choice(["en", "fr"]), rng.randrange(4)
        common = [f"{lang}common{rng.randrange(30)}" for _ in range(40)]
        rows.append((k, " ".join(common + [rng.choice(themes[theme]) for _ in range(60)]), lang, f"theme{theme}"))
    got = collections.Counter((r.source, r.lang, r.topic) for r in mixing.sample(spark, documents(rows)).collect())
    whole = collections.Counter(r[3] for r in rows)
    for theme in whole:
        best = max(collections.Counter({t: sum(n for (s, _, x), n in got.items() if s == theme and x == t) for t in {x for _, _, x in got}}).values())
        assert best > 0.5 * whole[theme]
    languages = {t: {lang for (_, lang, x), n in got.items() if x == t and n > 5} for t in {x for _, _, x in got}}
    assert sum(len(v) == 2 for v in languages.values()) >= 3


@pytest.mark.parametrize("budget", [0.9, 0.05])
def test_marginals_of_the_sample_are_the_targets(spark, documents, budget):
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randrange(20, 60)), rng.choice("xy"), rng.choice("aaaaab")) for k in range(6000)]
    want = {"a": 0.4, "b": 0.6}
    got = {(r.marginal, r.category): r for r in mixing.marginals(mixing.sample(spark, documents(rows), {"source": want}, budget)).collect()}
    for category, share in want.items():
        assert abs(got["source", category].wanted - share) < 0.001
        assert abs(got["source", category].sampled - share) < 0.05
    assert got["source", "a"].present > 0.8


def test_mixing_awkward_rows(spark, documents):
    got = mixing.sample(spark, documents([*AWKWARD, (50, "some words here", None, None)])).collect()
    assert len(got) == len(AWKWARD) + 1
    assert all(r.probability == 1.0 and r.selected for r in got if r.tokens == 0)
    assert mixing.sample(spark, documents([])).collect() == []


def test_mixing_is_decided_by_the_document(spark, documents):
    rows = mix_rows()
    once = {r.doc_id: r.selected for r in mixing.sample(spark, documents(rows), budget=0.5).collect()}
    again = {r.doc_id: r.selected for r in mixing.sample(spark, documents(rows[::-1]).repartition(7), budget=0.5).collect()}
    assert once == again


def marginal(rows, key, amount):
    total = sum(amount(r) for r in rows)
    return {v: sum(amount(r) for r in rows if r[key] == v) / total for v in {r[key] for r in rows}}


@pytest.mark.parametrize("given", [None, {"lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}])
def test_sample_holds_the_raked_marginals_at_the_production_budget(spark, documents, given):
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.randrange(20, 120)), rng.choices(["en", "fr", "de", "es"], [61, 17, 13, 9])[0], rng.choices(["hot", "a", "b"], [70, 24, 6])[0]) for k in range(1500)]
    got = mixing.sample(spark, documents(rows), targets=given).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.rate for r in got) / total == pytest.approx(mixing.BUDGET, abs=1e-6)
    assert sum(r.tokens * r.copies for r in got) / total == pytest.approx(mixing.BUDGET, abs=0.03)
    for key in mixing.KEYS:
        raised = {v: x**mixing.TEMPER for v, x in marginal(got, key, lambda r: r.tokens).items()}
        target = (given or {}).get(key) or {v: x / sum(raised.values()) for v, x in raised.items()}
        expected, held = marginal(got, key, lambda r: r.tokens * r.rate), marginal(got, key, lambda r: r.tokens * r.copies)
        for v, share in target.items():
            assert expected[v] == pytest.approx(share, rel=1e-3)
            assert held[v] == pytest.approx(share, abs=0.02)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) and r.selected == (r.copies > 0) for r in got)


def test_categories_without_a_target_keep_their_share(spark, documents):
    rng = random.Random(14)
    rows = [(k, prose(rng, 40), [None, "en", "fr", "de"][k % 4]) for k in range(400)]
    got = mixing.sample(spark, documents(rows), targets={"lang": {"en": 0.6, "fr": 0.4}}).collect()
    expected = marginal(got, "lang", lambda r: r.tokens * r.rate)
    assert expected == pytest.approx({"": 0.25, "de": 0.25, "en": 0.3, "fr": 0.2}, rel=1e-3)


def test_pipeline_repeats_as_often_as_mixing_says(spark, documents):
    rng = random.Random(13)
    docs = documents([(k, prose(rng, 40), "en" if k % 20 else "es") for k in range(400)])
    copies = {r.doc_id: r.copies for r in mixing.sample(spark, docs).collect() if r.copies}
    assert max(copies.values()) > 1
    assert collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, "").collect()) == copies


# -- pipeline -----------------------------------------------------------------------------------------


def test_stages(spark, documents):
    rng = random.Random(20)
    base = prose(rng, 150)
    rows = [(100 + k, prose(rng, rng.randrange(30, 150)), "en", f"s{k % 3}") for k in range(80)]
    rows += [(200, base), (201, base), (202, base + " more"), (203, "a b c d e " * 40), (204, prose(rng, 60) + " token=abcdefgh12"), (204, rows[0][1])]
    rows += AWKWARD
    docs = documents(rows)
    for (name, stage), check in zip(corpus_pipeline.STAGES[:4], (_rules, _near, _secrets, _mix), strict=True):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        check(spark, docs, out)
        docs = spark.createDataFrame(out.collect(), docs.schema)
    coded = corpus_pipeline.STAGES[4][1](spark, docs, "").collect()
    assert sorted(r.doc_id for r in coded) == sorted(r.doc_id for r in docs.collect())


def _key(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def _rules(spark, docs, out):
    kept = {(r.doc_id, r.content) for r in outliers.judge(spark, docs).collect() if r.kept}
    ids = {i for i, _ in kept}
    assert {r.doc_id for r in out.collect()} == ids
    assert 203 not in ids and 1 not in ids


def _near(spark, docs, out):
    kept = sorted({r.doc_id for r in neardup.near_duplicates(spark, docs).collect() if r.kept})
    got = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert got == kept
    assert 200 in got and 201 not in got and 202 not in got
    assert [r.text.split()[-1] for r in out.collect() if r.doc_id == 204] == ["token=abcdefgh12"]  # its other row is a copy


def _secrets(spark, docs, out):
    texts = dict(_key(out))
    assert len(_key(out)) == len(_key(docs))
    assert not any("token=abcdefgh12" in (t or "") for t in texts.values())
    assert secret_ledger.findings_of_blobs(secret_ledger.update_ledger(out)).count() == 0


def _mix(spark, docs, out):
    kept = {r.doc_id for r in mixing.sample(spark, docs).collect() if r.selected}
    assert {r.doc_id for r in out.collect()} == kept


def test_registered_queries():
    assert sorted(queries.queries()) == sorted(["pipeline", *[n for n in queries.queries() if n.startswith("op")]])
    assert {n.split("_")[0] for n in queries.queries() if n != "pipeline"} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(queries.queries())
