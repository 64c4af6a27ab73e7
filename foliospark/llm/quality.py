"""Quality classifier by positive-unlabelled learning.

A small network is fitted on trusted positives and unlabelled texts under the non-negative
unbiased risk: the positives' loss weighted by the class prior, plus the unlabelled texts' loss
as negatives less the share that positives have in it, which is held at zero or above. The class
prior is estimated from positives and unlabelled texts; no negative label is ever read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import fold, held_out, map_texts, utf8_list
from foliospark.llm.rules import _measure
from foliospark.llm.sampling import HASH, drawn, first, one_a_key, texts_of

#: Trusted positives and unlabelled texts at most that the network is fitted on.
POSITIVES = 3000
UNLABELLED = 6000
THRESHOLD = 0.7
HIDDEN = 24
#: Steps of the fit, and unlabelled texts a step: small samples are gone through more often.
STEPS, BATCH = 720, 512
_N = 14 + 96


def features(text: bytes) -> np.ndarray:
    out = np.zeros(_N)
    n, chars, symbols, dup, repeat, lines = _measure(text)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = max(len(text), 1)
    words = text.split()
    w, k = max(n, 1), max(lines, 1)
    out[:14] = (
        np.log1p(n), chars / w, symbols / w, dup / k, repeat / w, byte[65:91].sum() / max(byte[65:91].sum() + byte[97:123].sum(), 1), byte[48:58].sum() / size,
        len(set(words)) / w, byte[128:].sum() / size, np.log1p(w / k), sum(len(x) <= 2 for x in words) / w, byte[33] / w, byte[124] / w, n == 0,
    )
    out[14:] = np.log1p(1000 * byte[32:128] / size)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        h = np.clip((x - self.mean) / self.scale, -6, 6)
        w1, b1, w2, b2 = self.layers
        return 1 / (1 + np.exp(-np.clip(np.tanh(h @ w1 + b1) @ w2 + b2[0], -30, 30)))


def non_negative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The risk of logits under logistic loss, and its gradient by them; where the negative part
    falls below zero the gradient lifts that part instead."""
    soft = lambda z: np.logaddexp(0, z)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n_p, n_u = max(len(positive), 1), max(len(unlabelled), 1)
    plus = prior * soft(-positive).mean()
    minus = soft(unlabelled).mean() - prior * soft(positive).mean()
    g_u, g_p = sig(unlabelled) / n_u, -prior * sig(positive) / n_p
    if minus < 0:
        return plus, -g_p, -g_u
    return plus + minus, -prior * sig(-positive) / n_p + g_p, g_u


def train(p: np.ndarray, u: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray) -> Model:
    """A model from scaled features of positives and unlabelled rows."""
    if not len(p) or not len(u):
        return Model(mean, scale, [], prior)
    rng = np.random.default_rng(11)
    layers = [rng.normal(0, 1 / np.sqrt(_N), (_N, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    steps = max(1, len(u) // BATCH)
    t = 0
    for _ in range(-(-STEPS // steps)):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for a, b in zip(np.array_split(pi, steps), np.array_split(ui, steps), strict=True):
            x = np.concatenate([p[a], u[b]])
            h = np.tanh(x @ layers[0] + layers[1])
            f = h @ layers[2] + layers[3][0]
            _, gp, gu = non_negative_risk(f[: len(a)], f[len(a) :], prior)
            g = np.concatenate([gp, gu])
            gh = np.outer(g, layers[2]) * (1 - h * h)
            grads = [x.T @ gh + 1e-4 * layers[0], gh.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])]
            t += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                layers[k] = layers[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, layers, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in unlabelled rows, from positives and unlabelled rows alone.

    A logistic discriminator of the two is fitted on one half and ranks the other. The share cannot
    be more than unlabelled over positive rows above any rank; the estimate is that ratio at the rank
    where it, with its margin of error, is least (best bin estimation).
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for half in (0, 1):
        mine, other = [x[half::2] for x in (positive, unlabelled)], [x[1 - half :: 2] for x in (positive, unlabelled)]
        x, y = np.c_[np.ones(sum(map(len, mine))), np.concatenate(mine)], np.r_[np.ones(len(mine[0])), np.zeros(len(mine[1]))]
        w = np.zeros(x.shape[1])
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
        p, u = (np.sort(r @ w[1:])[::-1] for r in other)
        above_p = np.arange(1, len(p) + 1) / len(p)
        above_u = np.searchsorted(-u, -p, side="right") / len(u)
        margin = 1.01 * (np.sqrt(np.log(40) / (2 * len(u))) + np.sqrt(np.log(40) / (2 * len(p))))
        k = int(np.argmin((above_u + margin) / above_p))
        found.append(above_u[k] / above_p[k])
    return float(np.clip(np.mean(found), 0.01, 0.99))


def _matrix(rows: DataFrame, key: str, text: str, size: int) -> np.ndarray:
    added = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = first(map_texts(rows, text, [key, HASH], added, lambda texts: [[features(t) for t in texts]]).toArrow(), key, size)
    return np.array([r["x"] for r in got]).reshape(-1, _N)


#: Features are summed as whole numbers of this fraction, so sums don't depend on their order.
_UNIT = 2**-16


def moments(docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each feature over all rows of docs. _N rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, n = np.zeros(_N, np.int64), np.zeros(_N, np.int64), 0
        for batch in batches:
            for t in utf8_list(batch.column(0)):
                x = features(t)
                one += np.rint(x / _UNIT).astype(np.int64)
                two += np.rint(x * x / _UNIT).astype(np.int64)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_N), pa.int32()), pa.array(one), pa.array(two), pa.array([n] * _N, pa.int64())], names=["at", "one", "two", "n"])

    rows = docs.select(text).mapInArrow(run, "at int, one long, two long, n long").groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("one", "two", "n")]).collect()
    mean, square = np.zeros(_N), np.ones(_N)
    for r in rows:
        if r["n"]:
            mean[r["at"]], square[r["at"]] = r["one"] * _UNIT / r["n"], r["two"] * _UNIT / r["n"]
    return mean, np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from training rows only. Of labels only those of trusted positives (1) are read; the prior
    is estimated from them and the unlabelled texts. Means and scales are of all texts of docs."""
    mean, scale = moments(docs, text)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    trusted = drawn(labels.where(F.col(label) == 1).select(F.col(key).alias("__key"), F.col(label).alias("__one")), "__key", POSITIVES)
    some = one_a_key(drawn(rows, "__key", UNLABELLED), "__text")
    positive = _matrix(texts_of(rows, trusted, "__key", "__text", "__one"), "__key", "__text", POSITIVES)
    unlabelled = _matrix(some, "__key", "__text", UNLABELLED)
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    return train(p, u, class_prior(p, u), mean, scale)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns with ``score`` (0 to 1) and ``predicted`` (1 at THRESHOLD or above).

    Null texts count as empty; equal texts get equal scores; nothing but the text is read.
    Without positives or texts to learn from every score is the prior.
    """
    added = T.StructType([T.StructField("score", T.DoubleType())])

    def kernel(texts: list[bytes]) -> list:
        return [model.score(np.array([features(t) for t in texts]).reshape(-1, _N))]

    out = map_texts(docs, text, [c for c in (docs.columns if carry is None else carry) if c.lower() != "predicted"], added, kernel)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    return predict(docs, model, carry=["doc_id"]).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
