"""The fitted models: held-out accuracy on small synthetic corpora, and edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from foliospark.llm import langid, lbl, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
EDGE = [None, "", " ", "\n\n", "12 34 !!", "word " * 20000]


def corpus(n, seed=0):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "to", "mi", "re"], "bb": ["schl", "ung", "ver", "heit"]}
    rows, labels = [], []
    for k in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60, 120))]
        good, bad = int(rng.random() < 0.8), int(rng.random() < 0.3)
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "grumf" + rng.choice(syllables[lang])]))
        if not good:
            words = [w.upper() + "!!" for w in words[:20]] * 4
        rows.append((k, " ".join(words), lang, "s"))
        labels.append((k, good, bad))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus(600)
    extra = [(10_000 + k, t, None, None) for k, t in enumerate(EDGE)] + [(None, "ka to mi", "aa", "s"), (10_001, "", None, None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA).selectExpr("*", "5 AS score", "'x' AS predicted", "0 AS at")
    return docs.cache(), spark.createDataFrame([*labels, (None, 1, 0), (99_999, 1, 1), (0, None, None)], "doc_id long, quality int, toxic int").cache(), len(rows + extra), {k: (g, b) for k, g, b in labels}, {k: x for k, _, x, _ in rows}


def by_id(df, n):
    rows = df.collect()
    assert len(rows) == n
    return {r["doc_id"]: r for r in rows}


def test_language_id(tables):
    docs, _, n, _, langs = tables
    got = by_id(langid.query(docs), n)
    out = [k for k in langs if got[k]["held_out"]]
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in langs)
    assert np.mean([got[k]["lang_pred"] == langs[k] for k in out]) > 0.98
    for k in range(5):
        assert got[10_000 + k]["lang_pred"] == "und" and got[10_000 + k]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[None]["held_out"] is False
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} >= set(langs)
    assert langid.query(docs.limit(0)).count() == 0


def test_temperature_is_the_grid_minimum():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    logits = np.eye(3)[np.where(rng.random(400) < 0.9, y, (y + 1) % 3)] * 50
    assert langid.temperature(logits, y) > 1


def test_quality(tables):
    docs, labels, n, want, _ = tables
    got = by_id(quality.query(docs, labels), n)
    out = [k for k in want if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == want[k][0] for k in out]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[10_000]["score"] == got[10_001]["score"]
    assert quality.query(docs.limit(0), labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.query(docs, labels.limit(0)).collect()} == {0.5}


def test_non_negative_risk_gradients():
    rng = np.random.default_rng(1)
    p, u = rng.normal(size=7), rng.normal(size=9)
    risk, gp, gu = quality.non_negative_risk(p, u, 0.3)
    for z, g in ((p, gp), (u, gu)):
        for k in range(len(z)):
            z[k] += 1e-6
            assert (quality.non_negative_risk(p, u, 0.3)[0] - risk) / 1e-6 == pytest.approx(g[k], abs=1e-4)
            z[k] -= 1e-6
    _, gp, gu = quality.non_negative_risk(np.full(5, 4.0), np.full(5, -4.0), 0.9)
    assert (gu < 0).all()  # the negative part is below zero and is lifted


def test_toxicity(tables):
    docs, labels, n, want, _ = tables
    got = by_id(toxicity.query(docs, labels), n)
    out = [k for k in want if got[k]["held_out"]]
    assert np.mean([got[k]["predicted"] == want[k][1] for k in out]) > 0.95
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    marked = [texts[k][s["begin"] : s["end"]].lower() for k in out for s in got[k]["spans"] or []]
    assert marked and np.mean(["idiot" in m or "grumf" in m for m in marked]) > 0.95
    assert got[10_000]["predicted"] == 0 and got[10_000]["spans"] == []
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert toxicity.query(docs.limit(0), labels.limit(0)).count() == 0


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    trans, lengths = rng.normal(size=(2, 2)), np.array([3, 1, 4])
    u = rng.normal(size=8)
    p, steps, log_z = toxicity.marginals(u, lengths, trans, True)
    at, total_steps, total_z = 0, np.zeros((2, 2)), 0.0
    for n in lengths:
        z, on, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(u[at + k] for k in range(n) if path[k]) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            z += w
            on += w * np.array(path)
            for a, b in itertools.pairwise(path):
                moves[a, b] += w
        assert p[at : at + n] == pytest.approx(on / z)
        total_steps += moves / z
        total_z += math.log(z)
        at += n
    assert steps == pytest.approx(total_steps) and log_z == pytest.approx(total_z)


def test_lm_base_counts_and_normalised_scores(spark, tables):
    docs, _, n, _, _ = tables
    rows = lbl.query(docs).collect()
    assert len(rows) == n
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    tokens = {i: [*(t or "").lower().encode().split(), b""] for i, t in texts}
    counts = {}
    for i, t in texts:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*(t or "").lower().encode().split(), b""]:
                counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    base = score = 0.0
    for r in rows:
        w = tokens[r["doc_id"]]
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(x in counts for x in w) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w), rel=1e-9)
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base  # the model predicts held-out texts better than single words do
    assert lbl.query(docs.limit(0)).count() == 0
    assert {(r["base_score"], r["score"]) for r in lbl.score(docs.limit(3), docs.limit(0)).collect()} == {(0.0, 0.0)}


def test_lm_class_probabilities_add_up_to_one():
    noise = np.full(lbl.CLASSES, 1 / lbl.CLASSES)
    p = lbl.Parameters.fresh(noise)
    h = np.array([[3, 900]] * lbl.CLASSES)
    assert (10 ** lbl.Scorer(p).logs(np.arange(lbl.CLASSES), h)).sum() == pytest.approx(1)


def test_lm_looks_up_rare_words_by_a_join(spark, tables, monkeypatch):
    docs, _, n, _, _ = tables
    want = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in lbl.query(docs).collect()}
    monkeypatch.setattr(lbl, "HEAD", 40)
    got = {(r["doc_id"], r["n_tokens"]): r["base_score"] for r in lbl.query(docs).collect()}
    assert got == pytest.approx(want)


def test_nce_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(lbl, "CLASSES", 7)
    rng = np.random.default_rng(5)
    p = lbl.Parameters(rng.normal(size=(8, lbl.DIM)), rng.normal(size=(7, lbl.DIM)), rng.normal(size=7), rng.normal(size=(2, lbl.DIM)))
    h, w, k, lift = rng.integers(0, 8, (20, 2)), rng.integers(0, 7, 20), rng.integers(0, 7, 5), rng.normal(size=7)

    def loss():
        total = 0.0
        for (a, b), x in zip(h, w, strict=True):
            q = p.C[0] * p.R[a] + p.C[1] * p.R[b]
            total += np.logaddexp(0, -(q @ p.Q[x] + p.b[x] - lift[x])) + sum(np.logaddexp(0, q @ p.Q[y] + p.b[y] - lift[y]) for y in k)
        return total

    before = loss()
    for x, g in zip((p.R, p.Q, p.b, p.C), lbl.nce_gradients(p, h, w, k, lift), strict=True):
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(12)]:
            x[at] += 1e-6
            assert (loss() - before) / 1e-6 == pytest.approx(g[at], abs=1e-3)
            x[at] -= 1e-6


def test_lm_long_texts_go_in_portions(spark, tables, monkeypatch):
    """Portions of any size give the tokens, contexts and scores of whole texts."""
    texts = [b"", b"a b c d e", b" x " * 50, b"one two\nthree", b"q" * 300 + b" r", b"\t"]
    facts = type("F", (dict,), {"__missing__": lambda self, w: lbl.shared_class(w) if w else 5})()
    whole = list(lbl.portions(texts, facts))
    assert len(whole) == 1
    for size in (1, 4, 9, 60):
        monkeypatch.setattr(lbl, "PORTION", size)
        parts = list(lbl.portions(texts, facts))
        assert np.concatenate([x.h for x in parts]).tolist() == whole[0].h.tolist() and np.concatenate([x.classes for x in parts]).tolist() == whole[0].classes.tolist()
        assert [k for x in parts for k in x.ended] == list(range(len(texts)))
    docs, _, _, _, _ = tables
    some = docs.where("doc_id < 40 OR doc_id >= 10000").coalesce(1)
    monkeypatch.setattr(lbl, "train", lambda d, key, text, words: lbl.Parameters.fresh(words.totals / words.totals.sum()))
    monkeypatch.setattr(lbl, "PORTION", 1 << 20)
    want = {r["doc_id"]: r for r in lbl.score(some, docs).collect()}
    monkeypatch.setattr(lbl, "HEAD", 40)
    monkeypatch.setattr(lbl, "RARE", 3)
    rare = {r["doc_id"]: r for r in lbl.score(some, docs).collect()}
    for i, r in want.items():
        assert rare[i]["n_known"] == r["n_known"] and rare[i]["base_score"] == pytest.approx(r["base_score"])
    monkeypatch.setattr(lbl, "PORTION", 64)
    for r in lbl.score(some, docs).collect():
        assert tuple(r) == pytest.approx(tuple(rare[r["doc_id"]]))


def test_lm_head_is_cut_at_a_count(spark):
    counts = spark.createDataFrame([(b"w%d" % k, 1 + k // 3) for k in range(300)], "word binary, c long")
    got = lbl.head(counts, 40)
    assert 24 < len(got) <= 40 and got == sorted(((b"w%d" % k, 1 + k // 3) for k in range(300)), key=lambda x: (-x[1], x[0]))[: len(got)]
    assert lbl.head(counts.limit(0), 5) == []


def test_lm_scores_are_those_of_the_definition(spark, monkeypatch):
    """log10 of the class's probability given two classes, and of the word's smoothed share of its class."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 1200, 400)) for _ in range(8)] + ["", "W1 new words"]
    n = lbl.CLASSES
    p = lbl.Parameters(rng.normal(size=(n + 1, lbl.DIM)), rng.normal(size=(n, lbl.DIM)), rng.normal(size=n), rng.normal(size=(2, lbl.DIM)))
    monkeypatch.setattr(lbl, "train", lambda *_: p)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    train = docs.where("doc_id < 8")
    counts = {}
    for t in texts[:8]:
        for w in [*t.lower().split(), ""]:
            counts[w] = counts.get(w, 0) + 1
    order = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    own = set(order[: lbl.OWN])
    assert len(order) > lbl.OWN
    kind = lambda w: order.index(w) if w in own else lbl.shared_class(w.encode())
    for r in lbl.score(docs, train).collect():
        want, h = 0.0, [n, n]
        for w in [*texts[r["doc_id"]].lower().split(), ""]:
            s = p.Q @ (p.C[0] * p.R[h[0]] + p.C[1] * p.R[h[1]]) + p.b
            c = kind(w)
            want += (s[c] - np.log(np.exp(s).sum())) / math.log(10)
            if c >= lbl.OWN:
                total = 1 + sum(k + 1 for x, k in counts.items() if kind(x) == c)
                want += math.log10((counts.get(w, 0) + 1) / total)
            h = [c, h[0]]
        assert r["score"] == pytest.approx(want, rel=1e-5)
