"""Toxic spans by a linear-chain conditional random field, and the scores of documents.

A chain is one line of a text, its tokens the words. Labels are given for documents only, so
training tokens are labelled through them: a word or a prefix of words counts as toxic where
its documents are toxic almost always, and surely so by a confidence bound, in however small a share
of toxic documents. One without any such token has its likeliest marked, in it alone. The field is
fitted on these tokens.
Forward-backward marginals give each token's probability; a document's score is a calibrated
function of their maximum and their sum, and tokens likelier toxic than not are its spans.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import LOWER, fold, held_out, map_texts
from foliospark.llm.sampling import drawn, first, texts_of

#: Labelled documents of each class at most that the field is fitted on.
PER_CLASS = 1200
THRESHOLD = 0.3
#: A feature marks toxic tokens with this precision, if both classes were of one size, and where its
#: lower confidence bound (SURE standard deviations) is that high, too.
LEAST_PRECISION, LEAST_BOUND, SURE = 0.95, 0.75, 1.96
#: Features in fewer documents of the sample than this are not kept.
LEAST_DOCS = 4
EPOCHS = 8
#: Marginals under this don't count toward a text's sum.
LEAST_MARGINAL = 0.1
#: Words whose potentials a worker remembers; beyond that it starts anew.
CACHE = 300_000
_EDGES = b".,;:!?\"'()[]{}*&%$#|<>-"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def token_features(word: bytes) -> list[str]:
    """Features of a word of a lower-cased text: itself, prefixes, an ending, and its kind."""
    w = word.strip(_EDGES).decode("utf-8", "replace").lower()
    if not w:
        return ["k:mark"]
    out = ["w:" + w, "s:" + w[-3:]]
    out += [f"p:{w[:k]}" for k in (4, 5, 6) if len(w) >= k]
    if any(map(str.isdigit, w)):
        out.append("k:digit")
    return out


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling length: their order, the start of each, and how many reach each step."""
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate([[0], np.cumsum(lengths)])[order]
    top = int(lengths.max()) if len(lengths) else 0
    reach = np.searchsorted(-lengths[order], -np.arange(1, top + 1), side="right")
    return order, starts, reach


def marginals(u: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairwise: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) of each token by forward-backward over all chains at once.

    u: potential of toxic over clean by token; trans[i, j]: potential of a step from i to j.
    With pairwise also the expected count of each step; last, the log-partition.
    """
    order, starts, reach = _layout(lengths)
    e, w = np.exp(trans), np.exp(np.clip(u, -30, 30))
    f, scale = np.empty((len(u), 2)), np.ones(len(u))
    for t, n in enumerate(reach):
        at = starts[:n] + t
        prior = f[at - 1] @ e if t else np.ones((n, 2))
        prior[:, 1] *= w[at]
        s = prior.sum(1)
        f[at] = prior / s[:, None]
        scale[at] = s
    b = np.ones((len(u), 2))
    for t in range(len(reach) - 2, -1, -1):
        at = starts[: reach[t + 1]] + t
        ahead = b[at + 1].copy()
        ahead[:, 1] *= w[at + 1]
        b[at] = (ahead @ e.T) / scale[at + 1][:, None]
    p = f * b
    p = p[:, 1] / p.sum(1) if len(u) else np.empty(0)
    steps = np.zeros((2, 2))
    if pairwise and len(u):
        inner = np.ones(len(u), bool)
        inner[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = False
        at = np.flatnonzero(inner)
        ahead = b[at].copy()
        ahead[:, 1] *= w[at]
        steps = np.einsum("ni,ij,nj->ij", f[at - 1] / scale[at][:, None], e, ahead)
    return p, steps, float(np.log(scale).sum())


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    calibration: np.ndarray

    def potential(self, word: bytes) -> float:
        return self.bias + sum(self.weights.get(x, 0.0) for x in token_features(word))


class _Potentials(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.model.potential(word)
        return value


def _chains(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words, the length of each chain, and the number of words of each text."""
    words: list[bytes] = []
    lengths, per_text = [], []
    for text in texts:
        before = len(words)
        for line in text.translate(LOWER).split(b"\n"):
            w = line.split()
            if w:
                words += w
                lengths.append(len(w))
        per_text.append(len(words) - before)
    return words, np.array(lengths, np.int64), np.array(per_text, np.int64)


def _numbered(texts: list[bytes]) -> tuple[dict[bytes, int], np.ndarray, list[np.ndarray]]:
    """The number of each distinct word, the numbers of all words, and the lengths of each text's chains. Words
    are held once, however often they occur."""
    numbers: dict[bytes, int] = {}
    ids, lengths = [], []
    for text in texts:
        words, n, _ = _chains([text])
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        lengths.append(n)
    return numbers, np.concatenate(ids), lengths


def _features_of(numbers: dict[bytes, int], chains: list[np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
    """The features in LEAST_DOCS texts and more, numbered from 1 in their order, and those of each word (0: none)."""
    names: dict[str, int] = {}
    table = np.zeros((len(numbers), 6), np.int32)
    for w, k in numbers.items():
        fs = [names.setdefault(x, len(names) + 1) for x in token_features(w)]
        table[k, : len(fs)] = fs
    docs_with = np.zeros(len(names) + 1, np.int64)
    for c in chains:
        docs_with[np.unique(table[c])] += 1
    index = {x: k + 1 for k, x in enumerate(sorted(x for x, j in names.items() if docs_with[j] >= LEAST_DOCS))}
    kept = np.zeros(len(names) + 1, np.int32)
    for x, k in index.items():
        kept[names[x]] = k
    return index, kept[table]


def summary(p: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Of each text: 1, the logit of the largest marginal, and the log of the sum of marginals of LEAST_MARGINAL and
    more, so that the many clean words of a long text don't add up to a toxic one."""
    out = np.zeros((len(per_text), 3))
    out[:, 0] = 1
    out[:, 1] = -12.0
    ends = np.cumsum(per_text)
    full = np.flatnonzero(per_text)
    if len(full):
        starts = (ends - per_text)[full]
        most = np.clip(np.maximum.reduceat(p, starts), 6.2e-6, 1 - 6.2e-6)
        out[full, 1] = np.log(most / (1 - most))
        out[full, 2] = np.log1p(np.add.reduceat(np.where(p >= LEAST_MARGINAL, p, 0.0), starts))
    return out


def _spans(text: str, p: np.ndarray) -> list[dict]:
    found: list[dict] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(text)):
        if p[k] >= 0.5:
            if found and last == k - 1 and "\n" not in text[found[-1]["end"] : m.start()]:
                found[-1]["end"] = m.end()
            else:
                found.append({"begin": m.start(), "end": m.end()})
            last = k
    return found


def without_copies(texts: list[bytes]) -> list[int]:
    """Places of the texts to learn from: of exact and near copies only the first, since the copies
    of one toxic text would make each of its words look toxic. A text is a copy if at least three
    of its eight least hashes of three words are those of one and the same text kept before."""
    holders: dict[int, list[int]] = {}
    out = []
    for k, text in enumerate(texts):
        w = text.translate(LOWER).split()
        sketch = sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:8]
        shared = Counter(j for h in sketch for j in holders.get(h, ()))
        if 8 * max(shared.values(), default=0) < 3 * len(sketch):
            out.append(k)
            for h in sketch:
                holders.setdefault(h, []).append(k)
    return out


def surely(n: int, other: int, share: float) -> float:
    """Lower bound of a feature's precision, if both classes were of one size: Wilson's bound of the share
    of toxic ones among the n + other documents that hold it; share: of toxic ones among all."""
    m, z = n + other, SURE * SURE
    low = (n + z / 2 - SURE * (n * other / m + z / 4) ** 0.5) / (m + z)
    return low * (1 - share) / (low * (1 - share) + (1 - low) * share)


def token_labels(chains: list[list[bytes]], toxic: list[bool]) -> tuple[set[str], dict[str, float]]:
    """The word and prefix features that mark toxic tokens, by how toxic their documents are, and the
    bounds of those that are likelier in toxic documents than not."""
    seen: Counter = Counter()
    total = [max(1, toxic.count(False)), max(1, toxic.count(True))]
    for words, bad in zip(chains, toxic, strict=True):
        if bad:
            seen.update({x for w in set(words) for x in token_features(w) if x[0] in "wp"})
    often = {x: n for x, n in seen.items() if n >= LEAST_DOCS}
    clean: Counter = Counter()
    for words, bad in zip(chains, toxic, strict=True):
        if not bad:
            clean.update({x for w in set(words) for x in token_features(w) if x in often})
    marks, likely = set(), {}
    for x, n in often.items():
        bad, good, bound = n / total[1], (clean[x] + 0.5) / total[0], surely(n, clean[x], total[1] / sum(total))
        if bound >= LEAST_BOUND and bad / (bad + good) >= LEAST_PRECISION:
            marks.add(x)
        if bound > 0.5:
            likely[x] = bound
    return marks, likely


def toxic_words(chains: list[list[bytes]], toxic: list[bool]) -> list[set[bytes]]:
    """The words of each text to learn as toxic: those marked, or without any the likeliest. A toxic
    document has none only if all its features are as frequent in clean ones or too rare to learn."""
    marks, likely = token_labels(chains, toxic)
    out: list[set[bytes]] = []
    for words, bad in zip(chains, toxic, strict=True):
        features = {w: token_features(w) for w in set(words)} if bad else {}
        found = {w for w, fs in features.items() if any(x in marks for x in fs)}
        if not found:
            best = {w: max((likely.get(x, 0.0) for x in fs), default=0.0) for w, fs in features.items()}
            top = max(best.values(), default=0.0)
            found = {w for w, x in best.items() if x == top > 0}
        out.append(found)
    return out


def train(texts: list[bytes], toxic: list[bool], share: float) -> Model:
    """The field and the calibration from labelled texts; share: of toxic ones among all labelled."""
    kept = without_copies(texts)
    texts, toxic = [texts[k] for k in kept], [toxic[k] for k in kept]
    if not any(toxic) or all(toxic):
        level = np.log(max(share, 1e-4) / max(1 - share, 1e-4))
        return Model({}, -10.0, np.zeros((2, 2)), np.array([level, 0.0, 0.0]))
    numbers, ids, by_text = _numbered(texts)
    del texts
    lengths, n_chains = np.concatenate(by_text), np.array([len(n) for n in by_text])
    per_text = np.array([n.sum() for n in by_text], np.int64)
    ends = np.cumsum(per_text)
    chains = [np.unique(ids[e - n : e]) for e, n in zip(ends, per_text, strict=True)]
    index, x = _features_of(numbers, chains)
    words = list(numbers)
    marked = toxic_words([[words[k] for k in c] for c in chains], toxic)
    y = np.zeros(len(ids), bool)
    for e, n, found in zip(ends, per_text, marked, strict=True):
        y[e - n : e] = np.isin(ids[e - n : e], [numbers[w] for w in found])
    del words, numbers, chains, marked
    of = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    weights, bias, trans = np.zeros(len(index) + 1), -2.0, np.zeros((2, 2))
    mw, vw = np.zeros_like(weights), np.zeros_like(weights)
    params, ms, vs = np.concatenate([[bias], trans.ravel()]), np.zeros(5), np.zeros(5)
    rng = np.random.default_rng(5)
    parts, t = 6, 0
    begins = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(len(lengths)), parts):
            if not len(part):
                continue
            at = np.concatenate([np.arange(begins[c], begins[c] + lengths[c]) for c in part])
            ws, ys = ids[at], y[at].astype(float)
            u = params[0] + weights[x].sum(1)[ws]
            p, steps, _ = marginals(u, lengths[part], params[1:].reshape(2, 2), True)
            d = p - ys
            inner = np.flatnonzero(~first[at])
            told = np.zeros((2, 2))
            np.add.at(told, (ys[inner - 1].astype(int), ys[inner].astype(int)), 1)
            by_word = np.bincount(ws, weights=d, minlength=len(x))
            g = np.bincount(x.ravel(), weights=np.repeat(by_word, x.shape[1]), minlength=len(weights)) + 0.02 * weights
            g[0] = 0
            gp = np.concatenate([[d.sum()], (steps - told).ravel()]) + 0.02 * params
            t += 1
            for a, m, v, h in ((weights, mw, vw, g), (params, ms, vs, gp)):
                m += 0.1 * (h - m)
                v += 0.01 * (h * h - v)
                a -= 0.25 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            weights[0] = 0
    model = Model({f: float(weights[k]) for f, k in index.items() if abs(weights[k]) > 1e-3}, float(params[0]), params[1:].reshape(2, 2), np.zeros(3))
    of_word = params[0] + weights[x].sum(1)
    last, sums = np.cumsum(n_chains), []
    for part in np.array_split(np.arange(len(per_text)), parts):
        if len(part):
            a, b = part[0], part[-1]
            u = of_word[ids[ends[a] - per_text[a] : ends[b]]]
            p, _, _ = marginals(u, lengths[last[a] - n_chains[a] : last[b]], model.trans)
            sums.append(summary(p, per_text[a : b + 1]))
    model.calibration = _calibrate(np.concatenate(sums), np.array(toxic, float), share)
    return model


def _calibrate(s: np.ndarray, y: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression of labels on summaries, each class weighted to its share, by Newton steps."""
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    c = np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(s @ c, -30, 30)))
        g = s.T @ (weight * (q - y)) + 0.05 * c
        h = (s * (weight * q * (1 - q))[:, None]).T @ s + 0.05 * np.eye(3)
        c = c - np.linalg.solve(h, g)
    return c


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from training rows only."""
    share = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double")).alias("p")).first()["p"]
    sample = drawn(labels.where(F.col(label).isin(0, 1)), key, per_class, label)
    rows = texts_of(docs.where(F.col(text).isNotNull()), sample, key, text, label)
    rows = first(rows.toArrow(), key, per_class, label)
    texts, toxic = [r[text].encode() for r in rows], [r[label] == 1 for r in rows]
    del rows
    return train(texts, toxic, 0.5 if share is None else share)


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns with ``score`` (0 to 1), ``predicted`` (1 at THRESHOLD or above) and ``spans``.

    spans are the code-point offsets [begin, end) of runs of toxic words in a line. Null and empty
    texts have no spans and the score of no toxic word. Equal texts get equal results; nothing but
    the text is read. Without both classes to learn from every score is the share of toxic rows.
    """
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    added = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])

    def kernel(texts: list[bytes], known: _Potentials) -> list:
        words, lengths, per_text = _chains(texts)
        u = np.fromiter(map(known.__getitem__, words), float, len(words))
        p, _, _ = marginals(u, lengths, model.trans)
        z = summary(p, per_text) @ model.calibration
        ends = np.cumsum(per_text)
        spans = [_spans(x.decode("utf-8", "replace"), p[e - n : e]) if n and p[e - n : e].max() >= 0.5 else [] for x, e, n in zip(texts, ends, per_text, strict=True)]
        return [1 / (1 + np.exp(-np.clip(z, -30, 30))), spans]

    out = map_texts(docs, text, [c for c in (docs.columns if carry is None else carry) if c.lower() != "predicted"], added, kernel, lambda: _Potentials(model))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _model(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, _model(docs, labels), carry=["doc_id"])
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "spans")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less the rows predicted toxic. Columns are those of docs."""
    columns = docs.columns
    out = score(docs.withColumnsRenamed({c: f"d_{c}" for c in columns}), _model(docs, labels), text="d_text")
    return out.where("predicted = 0").select(*[F.col(f"`d_{c}`").alias(c) for c in columns])
