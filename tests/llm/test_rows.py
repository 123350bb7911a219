"""Operators that judge or rewrite each row: chat, outliers, secrets, tokens, quality, language."""

import base64
import hashlib
import math
import random
import re
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers as tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symbolgrid.llm import bpe, chat, langid, outliers, quality_gbt, queries, secret_ledger

from .conftest import AWKWARD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# -- chat -------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, source string, formatted string"
HARD = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "<\\|x", "<\\\\|im_end|>", "a <| b |> c", "<", "|im_end|>", "<|im_end|", "\\", "", None, "😀 <|im_start|>", "\n\n", "<|im_end|>\n<|im_start|>"]


def test_chat_round_trip(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "odd\nrole", "r\\n", "<|im_end|>"]
    rows = [(c, t, rng.choice(roles), rng.choice(HARD) if rng.random() < 0.7 else prose(rng, 5)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(90, 1, "user", "b"), (90, 1, "user", "a"), (90, 1, "user", "a"), (None, 0, "user", "no id"), (91, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    out = chat.format_chats(df).withColumn("learned", chat.under_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == len({r[0] for r in rows})
    for o in out:
        mine = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == o.conv_id)
        assert [(t["role"], t["text"]) for t in o.recovered] == [(r, x) for _, r, x in mine]
        assert o.learned == "".join(x for _, r, x in mine if r == "assistant")
        assert o.formatted.count(chat.OPEN) == o.formatted.count(chat.CLOSE) == len(mine)
        for (_, r, x), s in zip([m for m in mine if m[1] == "assistant"], o.loss_spans, strict=True):
            body = o.formatted[s["start"] : s["start"] + s["length"]]
            assert body == x or re.sub(r"<\\(\\*)\|", r"<\1|", body) == x


def test_chat_plain_text_is_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "x < y | z", "", ""), (2, 0, "user", "<|im_end|>", "", "")], TURNS)
    assert {r.conv_id: r.escaped for r in chat.format_chats(df).collect()} == {1: 0, 2: 1}
    assert chat.format_chats(df.limit(0)).collect() == []


# -- outliers ---------------------------------------------------------------------------------------


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    inside = {i for v in places.values() if len(v) > 1 for k in v for i in range(k, k + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_outliers(spark, documents):
    rng = random.Random(6)
    rows = [(100 + k, prose(rng, rng.randrange(20, 300)), "en", f"s{k % 2}") for k in range(160)]
    rows += [(300 + k, " ".join(f"w{rng.randrange(400)}***$$#" for _ in range(120)), "en", "s0") for k in range(12)]
    rows += [(400, "a b c d e " * 40), (401, "x " * 500), (402, "l one\nl one\nl two\n \nl one " + prose(rng, 40)), (403, prose(rng, 30), None, None)]
    rows += [(404, "a b c d e f a b c d e g " + prose(rng, 60))] + AWKWARD
    got = outliers.judge(spark, documents(rows)).collect()
    base = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=str)
    assert base == sorted([(r[0], *brute_base(r[1])) for r in rows], key=str)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[100 + k] for k in range(160))
    assert not any(kept[300 + k] for k in range(12))
    assert all(not r.kept for r in got if r.base_failed)
    assert outliers.judge(spark, documents([])).collect() == []


def test_estimate_resists_a_third_of_outliers(spark, documents):
    rng = random.Random(8)
    rows = [(k, prose(rng, 100), "en", "s") for k in range(200)] + [(1000 + k, " ".join(f"w{rng.randrange(400)}&&&&" for _ in range(100)), "en", "s") for k in range(80)]
    kept = {r.doc_id: r.kept for r in outliers.judge(spark, documents(rows)).collect()}
    assert all(kept[k] for k in range(200))
    assert not any(kept[1000 + k] for k in range(80))


def test_cutoff_is_the_stated_quantile():
    x = outliers.CUTOFF  # the upper tail of chi-square with five degrees of freedom in closed form
    tail = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2) * (1 + x / 3)
    assert tail == pytest.approx(1e-5, rel=1e-3)


def test_planted_menus_go_and_clean_text_stays(spark, documents):
    rng = random.Random(9)
    clean = [(k, prose(rng, rng.randrange(20, 200)) + rng.choice(["", "", " a & b", " #1", " <b>"]), "en", "s") for k in range(200)]
    menus = [(1000 + k, " | ".join(prose(rng, 12).split(" ")), "en", "s") for k in range(40)]
    got = {r.doc_id: r for r in outliers.judge(spark, documents(clean + menus)).collect()}
    assert all(got[i].kept for i, *_ in clean)
    assert not any(got[i].kept for i, *_ in menus)
    assert all(30 < got[i].distance ** 2 < 60 for i, *_ in menus)  # near enough to pass a cutoff of 60


# -- secrets ------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_spans(t):
    t = t or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found += [(m.start(), 3, "pem", m.end()) for m in re.finditer("-----BEGIN [A-Z ]*PRIVATE KEY-----", t)]
    found += [(m.start(), 4, "ghtoken", m.end()) for m in re.finditer("gh[pousr]_[A-Za-z0-9]{36,}", t)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def secret_texts(rng, n):
    parts = ["token:token:abcdef", "Password = 'hunter22'", "api_key=abc", "API-key: nothing", "AKIA" + "Q7" * 8, "AKIA" * 6, "AKIASHORT", "deadbeef" * 4, "0123456789abcdef0123456 ", "é😀",
             "secret:\t123456", "TOKEN==longvalue==", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 20, "passwd\"  :  \"x.y-z_9\"", "token=AKIA" + "B" * 20, " ", "\n", "ſecret=abcdefgh"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_secrets(spark, documents):
    rows = [(100 + k, t) for k, t in enumerate(secret_texts(random.Random(9), 200))] + AWKWARD
    docs = documents(rows)
    found = secret_ledger.findings_of_paths(docs, secret_ledger.update_ledger(docs))
    got = found.select("doc_id", secret_ledger.spans_text(F.col("spans")).alias("s")).collect()
    assert sorted([(r.doc_id, r.s) for r in got], key=str) == sorted([(i, brute_spans(t)) for i, t in rows], key=str)
    assert secret_ledger.update_ledger(documents([])).collect() == []


def test_ledger_scans_only_what_is_unseen(spark, documents):
    first = documents([(1, "token=abcdefgh"), (2, "token=abcdefgh"), (3, "clean")])
    ledger = secret_ledger.update_ledger(first)
    assert ledger.select("blob").distinct().count() == 2
    assert ledger.count() == 2 * len(secret_ledger.RULES)
    more = documents([(4, "token=abcdefgh"), (5, "AKIA" + "Z" * 16)])
    assert secret_ledger.update_ledger(first, ledger).count() == 0
    assert secret_ledger.update_ledger(more, ledger).count() == len(secret_ledger.RULES)
    newer = (secret_ledger.Rule("hex", 2, r"[0-9a-f]{8,}"), *[r for r in secret_ledger.RULES if r.kind != "hex"])
    again = secret_ledger.update_ledger(first, ledger, newer).collect()
    assert {(r.rule, r.version) for r in again} == {("hex", 2)}
    assert len(again) == 2


def test_redaction(spark, documents):
    docs = documents([(1, "é token=abcdefgh end AKIA" + "Q" * 16), (2, "clean"), (3, None), (4, "token=AKIA" + "B" * 20 + "!")])
    out = {r.doc_id: r for r in secret_ledger.redact_paths(docs, secret_ledger.update_ledger(docs)).collect()}
    assert out[1].text == "é [secret] end [secret]"
    assert (out[2].text, out[3].text, out[4].text) == ("clean", None, "[secret]!")
    assert out[1].n_chars == len(out[1].text)


# -- tokens -------------------------------------------------------------------------------------------

RANK_FILE = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(RANK_FILE, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.Codec(ranks, tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_library(codec, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    [ids] = codec.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces(codec, reference):
    rng = random.Random(10)
    for n in (63, 64, 65, 200, 5000):
        text = "".join(rng.choice("abcdeéß中") for _ in range(n))
        [ids] = codec.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    pieces = ["".join(rng.choice("abz é") for _ in range(rng.randrange(2, 20))).encode()[:64] for _ in range(500)]
    pieces = [p for p in pieces if len(p) >= 2]
    rows = bpe.merge_rows(pieces, codec.pair_rank, codec.byte_ids)
    assert [np.frombuffer(r, "<u4").tolist() for r in rows] == [bpe.merge_order(p, codec.ranks) for p in pieces]


def test_bpe_forgets_and_stays_right(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = [prose(random.Random(k), 20) for k in range(5)]
    for text in texts * 2:
        [ids] = codec.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_column(spark, documents, reference):
    rows = [(10, "Hello wörld, it's 123\n\n  ok")] + AWKWARD
    coded = bpe.encode_column(documents(rows), bpe.load_codec(spark, RANK_FILE, tokenizers.PATTERN)).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), bytes(raw), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in coded], key=str) == sorted(want, key=str)


# -- quality ------------------------------------------------------------------------------------------


def test_quality(spark, documents):
    rng = random.Random(11)
    good = [(k, prose(rng, rng.randrange(20, 150))) for k in range(150)]
    bad = [(500 + k, " ".join(f"W{rng.randrange(50)}!!" for _ in range(60))) for k in range(60)]
    docs = documents(good + bad + AWKWARD)
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:40]] + [(None, 1), (3, None), (good[0][0], 1)], "doc_id long, label int")
    trees = quality_gbt.fit(spark, docs, labels)
    scores = quality_gbt.score(spark, docs, trees).collect()
    assert len(scores) == len(good + bad + AWKWARD)
    assert all(0 <= r.score <= 1 for r in scores)
    by = {r.doc_id: r.score for r in scores}
    assert min(by[i] for i, _ in good[100:]) > 0.5 > max(by[i] for i, _ in bad[40:])


def test_quality_without_labels(spark, documents):
    docs = documents([(1, "a b c")])
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality_gbt.score(spark, docs, quality_gbt.fit(spark, docs, none)).first().score == 0.5
    one = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    assert quality_gbt.score(spark, docs, quality_gbt.fit(spark, docs, one)).first().score == pytest.approx(0.75)
    assert quality_gbt.score(spark, documents([]), quality_gbt.fit(spark, docs, one)).collect() == []


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 4))
    trees = quality_gbt.train(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=5)

    def walk(row):
        total = trees.start
        for s, t, v in zip(trees.statistic, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(s):
                node = 2 * node + 1 + (row[s[node]] > t[node])
            total += v[node - len(s)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.scores(x), [walk(r) for r in x])
    assert ((trees.scores(x) > 0.5) == (x[:, 0] + x[:, 1] > 0)).mean() > 0.9


# -- language -----------------------------------------------------------------------------------------


def brute_viterbi(scores, switch):
    best = [(s, [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v - (switch if p[-1] != k else 0) + row[k], [*p, k]) for v, p in best), key=lambda b: b[0]) for k in range(len(row))]
    return max(best, key=lambda b: b[0])


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(13)
    counts = np.array([3, 0, 1, 17, 8])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    scores = rng.normal(size=(counts.sum(), 3)) * 3
    labels = langid.viterbi(scores, first, counts, switch=2.0)
    for a, n in zip(first, counts, strict=True):
        if n:
            value, path = brute_viterbi(scores[a : a + n].tolist(), 2.0)
            mine = labels[a : a + n].tolist()
            total = sum(scores[a + i, k] for i, k in enumerate(mine)) - 2.0 * sum(x != y for x, y in zip(mine, mine[1:], strict=False))
            assert mine == path or total == pytest.approx(value)


EN, FR, RU = "the of and that with this from", "les des que dans pour avec une", "и в не на что как это"


def test_language(spark, documents):
    rng = random.Random(14)
    some = lambda words, n: " ".join(rng.choice(words.split()) for _ in range(n))
    rows = [(k, some({"en": EN, "fr": FR, "ru": RU}[lang], 60), lang) for k, lang in enumerate(["en", "fr", "ru"] * 20)]
    docs = documents(rows)
    model = langid.fit(spark, docs)
    assert model.languages == ["en", "fr", "ru"]
    mixed = some(EN, 30) + ". " + some(FR, 50) + " " + some(RU, 20)
    test = [(100, some(FR, 40), None), (101, mixed, None), (102, "123 !?", None), (103, "中文", None), *[(i, t, None) for i, t in AWKWARD]]
    got = langid.identify(spark, documents(test), model).collect()
    assert len(got) == len(test)
    by = {r.doc_id: r for r in got}
    assert (by[100].lang_pred, by[100].score) == ("fr", 1.0)
    assert [(s["start"], s["stop"], s["lang"]) for s in by[101].spans] == [(0, 30, "en"), (30, 80, "fr"), (80, 100, "ru")]
    assert by[101].lang_pred == "fr" and 0.3 < by[101].score < 0.7
    assert (by[102].lang_pred, by[102].score, by[102].spans) == ("und", 0.0, [])
    assert by[103].lang_pred in model.languages and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und"
    none = langid.fit(spark, documents([(1, "words", None)]))
    assert [r.lang_pred for r in langid.identify(spark, docs, none).limit(2).collect()] == ["und", "und"]


def test_letter_words():
    w = langid.LetterWords(pa.array(["Ab1c é", "", "𐐀x", "–"]))
    assert w.counts.tolist() == [3, 0, 1, 0]
    assert w.letters.tolist() == [2, 1, 1, 2]


def test_held_out_rows(spark):
    import zlib

    rows = spark.range(200).select(F.col("id"), queries.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def numpy_mcd(x, steps=50):
    """Minimum covariance determinant by plain concentration from several starts, with the operator's floors."""
    floors, n = np.diag(np.square(outliers.FLOORS)), len(x)
    h = int(np.ceil(outliers.SUPPORT * n))

    def estimate(part):
        cov = np.cov(part.T, bias=True)
        return part.mean(axis=0), (cov * len(part) + outliers.PRIOR * floors) / (len(part) + outliers.PRIOR) + floors

    def distance(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    best = None
    rng = np.random.default_rng(0)
    for k in range(60):
        m, c = (np.median(x, axis=0), np.diag(np.square(np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349))) if k == 0 else estimate(x[rng.permutation(n)[:8]])
        for _ in range(steps):
            m, c = estimate(x[np.argsort(distance(m, c), kind="stable")[:h]])
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, m, c
    return best


def test_estimates_equal_numpy(spark):
    from symbolgrid.llm.durable import Store

    rng = np.random.default_rng(3)
    mixing = rng.normal(size=(5, 5))
    groups = {}
    for lang, share in (("a", 0.0), ("b", 0.1), ("c", 0.28)):
        x = rng.normal(size=(600, 5)) @ mixing + 5
        x[: int(600 * share)] = rng.normal(size=(int(600 * share), 5)) * 0.3 + 30  # a tight cluster far away
        groups[lang] = x
    rows = [(g, "s", *map(float, v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in outliers.FEATURES))
    got = {r.lang: r for r in outliers.estimates(Store(spark, "mcd"), df).collect()}
    for g, x in groups.items():
        det, m, c = numpy_mcd(x)
        mine = got[g]
        assert abs(mine.log_det - det) < 0.1
        assert np.abs([mine[f"m_{i}"] - m[i] for i in range(5)]).max() < 0.15 * np.sqrt(np.diag(c)).max()
        far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        low = np.array([[mine[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        y = np.linalg.solve(low, (x - np.array([mine[f"m_{i}"] for i in range(5)])).T)
        assert np.allclose(np.median((y**2).sum(axis=0)), np.median(far), rtol=0.1)
