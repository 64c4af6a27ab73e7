"""Samples, and the fitted models' parts against plain versions."""

import math

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import langid, quality, rules, sampling, toxicity


def test_samples_stay_bounded_with_a_hot_class_and_a_hot_key(spark):
    rows = [(1, "x", "hot text")] * 10_000 + [(k, "x", f"t{k}") for k in range(2, 6000)] + [(k, "y", "s") for k in range(7000, 7050)] + [(None, "x", "n"), (9, None, "n")]
    df = spark.createDataFrame(rows, "k long, c string, t string").repartition(8)
    some = sampling.drawn(df, "k", 100, "c")
    assert some.count() < 400 + 10_000  # a key's own rows meet only in partial minima
    met = sampling.one_a_key(some, "t")
    assert met.count() < 400
    got = sampling.first(met.toArrow(), "k", 100, "c")
    assert [sum(r["c"] == c for r in got) for c in "xy"] == [100, 50]
    assert got == sampling.first(sampling.one_a_key(sampling.drawn(df.repartition(3), "k", 100, "c"), "t").toArrow(), "k", 100, "c")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1)], "k long, y int")
    texts = sampling.texts_of(df.select("k", "t"), sampling.drawn(labels, "k", 100, "y"), "k", "t", "y").collect()
    assert sorted((r["k"], r["y"], r["t"]) for r in texts) == [(1, 1, "hot text"), (2, 0, "t2"), (3, 1, "t3")]


def test_ftrl_is_the_per_coordinate_rule(monkeypatch):
    monkeypatch.setattr(langid, "DIM", 12)
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.normal(size=4)) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    got = langid.ftrl(rows, y, 3, 2)
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, c):
        if abs(z[i][c]) <= langid.L1:
            return 0.0
        return -(z[i][c] - math.copysign(langid.L1, z[i][c])) / ((langid.BETA + math.sqrt(n[i][c])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(30):
            at, v = rows[k]
            logits = [sum(x * weight(i, c) for i, x in zip(at, v, strict=True)) for c in range(3)]
            total = sum(map(math.exp, logits))
            steps = []
            for i, x in zip(at, v, strict=True):
                for c in range(3):
                    g = x * (math.exp(logits[c]) / total - (c == y[k]))
                    steps.append((i, c, g, (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / langid.ALPHA, weight(i, c)))
            for i, c, g, sigma, w in steps:
                z[i][c] += g - sigma * w
                n[i][c] += g * g
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(3)] for i in range(12)]))


def test_language_scores_are_those_of_the_definition():
    rows = ["ab ba abba", "xy yx xyyx", "ab xy"]
    feature = lambda t: langid.counts(t)
    idf = np.linspace(1, 2, langid.DIM)
    w = np.random.default_rng(1).normal(size=(langid.DIM, 2))
    model = langid.Model(["p", "q"], idf, w, 0.5)
    for t in rows:
        at, n = feature(t)
        v = {i: (1 + math.log(c)) * idf[i] for i, c in zip(at.tolist(), n.tolist(), strict=True)}
        size = math.sqrt(sum(x * x for x in v.values()))
        z = [sum(x / size * w[i, c] for i, x in v.items()) / 0.5 for c in (0, 1)]
        p = math.exp(max(z)) / sum(map(math.exp, z))
        assert model.predict(t) == ("pq"[int(z[1] > z[0])], pytest.approx(p))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_class_prior_comes_from_positives_and_unlabelled_rows(share):
    rng = np.random.default_rng(4)
    positive = rng.normal(2, 1, (2000, 5))
    good = rng.random(4000) < share
    unlabelled = np.where(good[:, None], rng.normal(2, 1, (4000, 5)), rng.normal(-2, 1, (4000, 5)))
    assert quality.class_prior(positive, unlabelled) == pytest.approx(share, abs=0.06)


def test_quality_moments_and_scores(spark):
    texts = ["", "one two three", "A b!\nA b!\nlong | line 123", None, "é ü"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    x = np.array([quality.features((t or "").encode()) for t in texts])
    mean, scale = quality.moments(docs, "text")
    assert mean == pytest.approx(x.mean(0), abs=1e-4) and scale == pytest.approx(x.std(0) + 1e-6, abs=2e-2)
    again = quality.moments(docs.repartition(1), "text")
    assert (again[0] == mean).all() and (again[1] == scale).all()
    rng = np.random.default_rng(2)
    layers = [rng.normal(size=(x.shape[1], 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    model = quality.Model(mean, scale, layers, 0.5)
    got = {r["doc_id"]: r["score"] for r in quality.predict(docs, model, carry=["doc_id"]).collect()}
    for k, row in enumerate(x):
        h = [max(-6, min(6, (a - m) / s)) for a, m, s in zip(row, mean, scale, strict=True)]
        hidden = [math.tanh(sum(a * layers[0][i, j] for i, a in enumerate(h)) + layers[1][j]) for j in range(3)]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(hidden, layers[2], strict=True)) + layers[3][0]))))


def test_copies_of_a_toxic_text_are_learned_once():
    base = " ".join(f"w{k}" for k in range(60)).encode()
    near = base.replace(b"w50", b"changed")
    other = " ".join(f"v{k}" for k in range(60)).encode()
    assert toxicity.without_copies([base, near, other, base, b"", b""])[:2] == [0, 2]


def test_a_clashing_carried_column(spark):
    docs = spark.createDataFrame([(1, "a b", "kept"), (2, None, "too")], "doc_id long, text string, __text string")
    got = {r["doc_id"]: r for r in rules.ledger(docs).collect()}
    assert got[1]["__text"] == "kept" and got[1]["n_words"] == 2 and got[2]["n_words"] == 0


def test_drawn_from_an_empty_table(spark):
    empty = spark.createDataFrame([], "k long, c string, t string")
    assert sampling.drawn(empty, "k", 5, "c").count() == 0 and sampling.drawn(empty, "k", 5).count() == 0
    assert sampling.first(pa.table({"k": [], sampling.HASH: []}), "k", 5) == []


def test_clean_words_of_a_long_text_do_not_add_up():
    for n in (10, 1_000_000):
        p = np.full(n, 2e-4)
        assert toxicity.summary(p, np.array([n]))[0, 2] == 0
    p[5] = 0.9
    assert toxicity.summary(p, np.array([n]))[0, 2] == pytest.approx(np.log1p(0.9))
