"""Language identification: sparse multinomial logistic regression on character n-grams.

N-grams of one to three code points of the lower-cased text are hashed into DIM features and
weighted by TF-IDF, with document frequencies over all training documents. The weights come
from follow-the-regularised-leader with an elastic net, on a bounded sample of labelled rows,
and a temperature fitted on a part of the sample that the weights don't see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import fold, held_out, map_texts, utf8_list
from foliospark.llm.sampling import HASH, drawn, one_a_key, places

DIM = 1 << 13
#: Labelled rows of each language at most that the weights are fitted on.
PER_LANGUAGE = 1200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
#: The corpus pipeline's stage keeps documents of a learned language with at least this score.
LEAST_SCORE = 0.5
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the n-grams in a text, and how often each occurs."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(p):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = p * 0x9E3779B1
    hashed = [one]
    if len(p) > 1:
        hashed.append(one[:-1] * 31 + p[1:] * 0x85EBCA77 + 7)
    if len(p) > 2:
        hashed.append(hashed[1][:-1] * 31 + p[2:] * 0xC2B2AE3D + 13)
    c = np.bincount(np.concatenate([(h ^ (h >> 15)) & (DIM - 1) for h in hashed]), minlength=DIM)
    at = np.flatnonzero(c)
    return at, c[at]


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / (np.sqrt(v @ v) or 1.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        at, n = counts(text)
        p = _softmax(tfidf(at, n, self.idf) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of FTRL-proximal with an elastic net, one pass over the rows an epoch."""
    z, n = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, v = rows[k]
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = _softmax(v @ w)
            p[y[k]] -= 1
            g = v[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[at] = more
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from a grid."""
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts. DIM rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for x in utf8_list(batch.column(0)):
                df[counts(x.decode("utf-8", "replace"))[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*df[at], n], pa.int64())], names=["at", "n"])

    rows = docs.select(text).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM, np.int64)
    total = 0
    for r in rows:
        if r["at"] < 0:
            total = r["n"]
        else:
            df[r["at"]] = r["n"]
    return df, total


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from docs, whose rows are all training rows; rows of a null language are not labelled."""
    named = docs.where(F.col(lang).isNotNull())
    df, total = document_frequencies(named, text)
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = drawn(named.select(key, lang, text), key, per_language, lang)
    added = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])

    def kernel(texts: list[bytes]) -> list:
        return list(zip(*(counts(x.decode("utf-8", "replace")) for x in texts), strict=True)) or [[], []]

    sample = sample.select(F.col(key).alias("__key"), F.col(lang).alias("__lang"), HASH, F.col(text).alias("__text"))
    got = map_texts(one_a_key(sample, "__text"), "__text", ["__key", "__lang", HASH], added, kernel).toArrow()
    kept = places(got, "__key", per_language, "__lang")
    spoken = got["__lang"].to_pylist()
    langs = sorted({spoken[k] for k in kept})
    if not langs:
        return Model([], idf, np.zeros((DIM, 0)), 1.0)
    y = np.array([langs.index(spoken[k]) for k in kept])
    # from Arrow's buffers to numpy's, since as Python's integers the counts take many times their size
    rows = [(at := got["at"][k].values.to_numpy(), tfidf(at, got["n"][k].values.to_numpy().astype(np.int64), idf)) for k in kept]
    check = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~check) if check.any() else np.arange(len(rows))
    w = ftrl([rows[k] for k in train], y[train], len(langs))
    t = temperature(np.array([rows[k][1] @ w[rows[k][0]] for k in np.flatnonzero(check)]), y[check]) if check.any() else 1.0
    return Model(langs, idf, w, t)


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns with ``lang_pred`` and ``score``.

    lang_pred is a learned language, or "und" with score 0 where the text is null, has no letter,
    or no language was learned. Equal texts get equal results; other columns are never read.
    """
    added = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def kernel(texts: list[bytes]) -> list:
        return list(zip(*(model.predict(x.decode("utf-8", "replace")) for x in texts), strict=True)) or [[], []]

    return map_texts(docs, text, docs.columns if carry is None else carry, added, kernel)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 3) != 1)


def query(docs: DataFrame) -> DataFrame:
    out = predict(docs, fit(training_rows(docs)), carry=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs less the rows without an identified language: "und", or a score under LEAST_SCORE."""
    columns = docs.columns
    out = predict(docs.withColumnsRenamed({c: f"d_{c}" for c in columns}), fit(training_rows(docs)), text="d_text")
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"`d_{c}`").alias(c) for c in columns])
