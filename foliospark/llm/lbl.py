"""Language-model scoring by a log-bilinear model, with a smoothed unigram model as base.

Tokens are lower-cased words and one end a text. Words are counted over all training documents.
The log-bilinear model predicts the class of a token from the classes of the two before: each of
the most frequent words is a class of its own, the others share classes by their last two bytes,
and within a class a word has its smoothed share of the class's counts. So a text's probability is
normalised over all words seen, and one unseen word a class.

Training is noise-contrastive estimation in numpy: a start on a few documents on the driver, then
one pass of every partition over all its training documents, whose parameters are averaged by how
often each partition saw a class. Scoring takes normalising sums over all classes, by batched
matrix products, once for each pair of context classes that a worker meets.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import LOWER, fold, held_out, materialize, small_batches, utf8_list
from foliospark.llm.sampling import drawn, first, one_a_key

#: Words that are classes of their own, and classes of the others.
OWN, SHARED = 768, 256
CLASSES = OWN + SHARED
DIM, NOISE, BATCH = 24, 64, 4096
#: Words whose counts every worker holds; rarer ones are looked up by a join.
HEAD = 150_000
#: Words a worker counts before it passes them on, texts of a batch, bytes of text and contexts handled at
#: once, and rare words of finished texts held: they bound its memory, whatever the length of a text.
COUNTED, TEXTS, PORTION, CONTEXTS, RARE = 300_000, 250, 1 << 20, 512, 100_000
#: Documents that the driver starts the model on before the pass over all of them.
START_DOCS = 400
RATE = 0.04
_END = b""
_CLASS_BITS = 11
_PAD = CLASSES


def shared_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % SHARED


@dataclass
class Parameters:
    """R: context vectors, the last row before a text's start; Q, b: predicted classes; C: one diagonal a position."""

    R: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    C: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray) -> Parameters:
        rng = np.random.default_rng(3)
        r, q = rng.normal(0, 0.1, (CLASSES + 1, DIM)), rng.normal(0, 0.1, (CLASSES, DIM))
        return cls(r, q, np.log(noise), np.ones((2, DIM))).cast(np.float32)

    def cast(self, kind: type) -> Parameters:
        return Parameters(*(x.astype(kind) for x in (self.R, self.Q, self.b, self.C)))

    def predict(self, h: np.ndarray) -> np.ndarray:
        return self.C[0] * self.R[h[:, 0]] + self.C[1] * self.R[h[:, 1]]


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by the number in ``at``."""
    order = np.argsort(at.astype(np.int16), kind="stable")
    ordered = at[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[ordered[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.maximum(z, -30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


def nce_gradients(p: Parameters, h: np.ndarray, w: np.ndarray, k: np.ndarray, lift: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients by R, Q, b and C of the noise-contrastive loss of classes w in contexts h against noise
    samples k, which all tokens share: -log sig(s_w - lift_w) - sum over k of log sig(lift_k - s_k)."""
    r1, r2 = p.R[h[:, 0]], p.R[h[:, 1]]
    q = p.C[0] * r1 + p.C[1] * r2
    true, noise = p.Q[w], p.Q[k]
    gp = _sigmoid(np.einsum("ij,ij->i", q, true) + (p.b[w] - lift[w])) - 1
    gn = _sigmoid(q @ noise.T + (p.b[k] - lift[k]))
    dq = gn @ noise
    true *= gp[:, None]
    dq += true
    dQ = _scatter(np.concatenate([w, k]), np.concatenate([gp[:, None] * q, gn.T @ q]), CLASSES)
    db = np.bincount(np.concatenate([w, k]), weights=np.concatenate([gp, gn.sum(0)]), minlength=CLASSES).astype(p.b.dtype)
    dR = _scatter(np.concatenate([h[:, 0], h[:, 1]]), np.concatenate([p.C[0] * dq, p.C[1] * dq]), CLASSES + 1)
    return dR, dQ, db, np.stack([(r1 * dq).sum(0), (r2 * dq).sum(0)])


class Trainer:
    """Noise-contrastive steps under AdaGrad. A batch of tokens shares its noise samples."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int):
        self.p, self.noise, self.rng = start.cast(np.float32), noise, np.random.default_rng(seed)
        self.sums = [np.full_like(x, 1e-2) for x in (self.p.R, self.p.Q, self.p.b, self.p.C)]
        self.seen = np.zeros(CLASSES + 1)
        self.lift = np.log(NOISE * noise).astype(np.float32)

    def step(self, h: np.ndarray, w: np.ndarray) -> None:
        k = self.rng.choice(CLASSES, NOISE, p=self.noise)
        for x, s, g in zip((self.p.R, self.p.Q, self.p.b, self.p.C), self.sums, nce_gradients(self.p, h, w, k, self.lift), strict=True):
            g /= len(w) ** 0.5
            s += g * g
            x -= RATE * g / np.sqrt(s)
        self.seen[:CLASSES] += np.bincount(w, minlength=CLASSES)

    def run(self, classes: np.ndarray, h: np.ndarray) -> None:
        order = self.rng.permutation(len(classes))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            self.step(h[some], classes[some])


@dataclass
class Vocabulary:
    """What scoring needs of the counts: the head's classes and counts, and each class's smoothed total."""

    n: int
    v: int
    facts: dict[bytes, int]
    totals: np.ndarray = field(repr=False)


class _Facts(dict):
    """A word's class, and above it its count where the head has it, else 0, as one number."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.facts)
        self.tails: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        tail = word[-2:]
        k = self.tails.get(tail)
        if k is None:
            k = self.tails[tail] = shared_class(tail)
        return k


_BLANK = re.compile(rb"[ \t-\r]")


def tokens(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The tokens of a text in parts of about PORTION bytes at most, and whether a part is the last, which
    ends in the end. Only a single word may be longer."""
    at = 0
    while len(text) - at > PORTION:
        cut = _BLANK.search(text, at + PORTION)
        if not cut:
            break
        yield text[at : cut.start()].translate(LOWER).split(), False
        at = cut.start()
    out = (text[at:] if at else text).translate(LOWER).split()
    out.append(_END)
    yield out, True


@dataclass
class Portion:
    """Tokens handled at once: the numbers of their texts, the words of each, the numbers of texts that end
    here, and of all words the classes, the head's counts and the contexts."""

    of: list[int]
    words: list[list[bytes]]
    ended: list[int]
    classes: np.ndarray
    counts: np.ndarray
    h: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0, *[len(x) for x in self.words[:-1]]])


def portions(texts: list[bytes], facts: _Facts) -> Iterator[Portion]:
    """All tokens of the texts, about PORTION bytes at a time; contexts reach over portions of one text."""
    of: list[int] = []
    words: list[list[bytes]] = []
    ended: list[int] = []
    size, before, going = 0, (_PAD, _PAD), False

    def done() -> Portion:
        nonlocal before
        flat = np.fromiter(map(facts.__getitem__, chain.from_iterable(words)), np.int64)
        classes = flat & ((1 << _CLASS_BITS) - 1)
        h = contexts(classes, [len(x) for x in words], before)
        before = (int(classes[-1]), int(h[-1, 0])) if going else (_PAD, _PAD)
        return Portion(of, words, ended, classes, flat >> _CLASS_BITS, h)

    for k, text in enumerate(texts):
        for part, last in tokens(text):
            if part:
                of.append(k)
                words.append(part)
            if last:
                ended.append(k)
            size += min(len(text), PORTION)
            going = not last
            if size >= PORTION and words:
                yield done()
                of, words, ended, size = [], [], [], 0
    if words:
        yield done()


def contexts(classes: np.ndarray, lengths: list[int], before: tuple[int, int] = (_PAD, _PAD)) -> np.ndarray:
    """The two classes before each token, nearest first, within its text; before: those before the first."""
    h = np.full((len(classes), 2), _PAD)
    h[1:, 0] = classes[:-1]
    h[2:, 1] = classes[:-2]
    starts = np.cumsum([0, *lengths[:-1]])
    h[starts] = _PAD
    second = starts + 1
    h[second[second < len(classes)], 1] = _PAD
    h[0] = before
    if len(classes) > 1 and lengths[0] > 1:
        h[1, 1] = before[0]
    return h


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, class, c) over all rows; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array([shared_class(w) for w in n], pa.int32()), pa.array(n.values(), pa.int64())], names=["word", "class", "c"])

        n = Counter()
        for batch in batches:
            for x in utf8_list(batch.column(0)):
                for part, _ in tokens(x):
                    n.update(part)
                    if len(n) > COUNTED:
                        yield counted()
                        n.clear()
        yield counted()

    return docs.select(text).mapInArrow(run, "word binary, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


def head(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The words of at least some count, with it, most frequent first: as many as there are of the least
    count on a fixed scale that ``size`` words or fewer have. Only these and the scale come to the driver."""
    level = F.floor(F.log2("c") * 16).cast("int")
    scale = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, None
    for r in sorted(scale, key=lambda r: -r["level"]):
        total += r["n"]
        if total > size:
            break
        least = r["level"]
    if least is None:
        return []
    top = counts.where(level >= least).select("word", "c").toArrow().to_pydict()
    return sorted(zip(top["word"], top["c"], strict=True), key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = head(counts, HEAD)
    own = {w: k for k, (w, _) in enumerate(top[:OWN])}
    sums = np.ones(CLASSES)
    for r in counts.groupBy("class").agg(F.sum(F.col("c") + 1).alias("s")).collect():
        sums[r["class"]] += r["s"]
    for w, c in top[:OWN]:
        sums[shared_class(w)] -= c + 1
        sums[own[w]] = c
    facts = {w: (own[w] if w in own else shared_class(w)) | c << _CLASS_BITS for w, c in top}
    return Vocabulary(total["n"], total["v"], facts, sums)


def train(docs: DataFrame, key: str, text: str, words: Vocabulary) -> Parameters:
    """Parameters from all rows of docs."""
    noise = words.totals / words.totals.sum()
    p = Parameters.fresh(noise)
    if not words.v:
        return p
    sample = drawn(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", START_DOCS)
    texts = [r["__text"].encode() for r in first(one_a_key(sample, "__text").toArrow(), "__key", START_DOCS) if r["__text"]]
    if texts:
        facts, trainer = _Facts(words), Trainer(p, noise, 0)
        for _ in range(4):
            for x in portions(texts, facts):
                trainer.run(x.classes, x.h)
        p = trainer.p
    start = p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, trainer = _Facts(words), Trainer(start, noise, 1 + TaskContext.get().partitionId())
        some = False
        for batch in batches:
            for x in portions(utf8_list(batch.column(0)), facts):
                trainer.run(x.classes, x.h)
                some = True
        if some:
            # R, then Q with b as one more column, then C; a row weighs as often as its class was seen
            p, seen = trainer.p, trainer.seen
            seen[_PAD] = seen[:_PAD].sum()
            zero = np.zeros((len(p.R), 1))
            table = np.concatenate([np.c_[p.R, zero], np.c_[p.Q, p.b], np.c_[p.C, np.zeros((2, 1))]])
            weight = np.concatenate([seen, seen[:_PAD], [seen[_PAD]] * 2]) + 1.0
            columns = [pa.array(np.arange(len(table)), pa.int32()), pa.array(weight), *map(pa.array, table.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "weight", *names])

    names = [f"x{k}" for k in range(DIM + 1)]
    schema = "at int, weight double, " + ", ".join(f"{n} double" for n in names)
    mean = docs.select(text).mapInArrow(run, schema).groupBy("at").agg(*[(F.sum(F.col(n) * F.col("weight")) / F.sum("weight")).alias(n) for n in names])
    table = np.zeros((2 * CLASSES + 3, DIM + 1))
    got = mean.toArrow().to_pydict()
    if got["at"]:
        table[got["at"]] = np.stack([got[n] for n in names], 1)
        return Parameters(table[: CLASSES + 1, :DIM], table[CLASSES + 1 : -2, :DIM], table[CLASSES + 1 : -2, DIM], table[-2:, :DIM])
    return start


class Scorer:
    """Normalised log10 probabilities of classes given two before, with the sums met so far."""

    def __init__(self, p: Parameters):
        self.p = p.cast(np.float64)
        self.near, self.far = self.p.C[0] * self.p.R, self.p.C[1] * self.p.R
        self.log_z = np.full((CLASSES + 1) * (CLASSES + 1), np.nan)

    def logs(self, classes: np.ndarray, h: np.ndarray) -> np.ndarray:
        pair = h[:, 0] * (CLASSES + 1) + h[:, 1]
        new = np.unique(pair[np.isnan(self.log_z[pair])])
        for at in range(0, len(new), CONTEXTS):
            some = new[at : at + CONTEXTS]
            s = self.p.predict(np.stack([some // (CLASSES + 1), some % (CLASSES + 1)], 1)) @ self.p.Q.T + self.p.b
            most = s.max(1)
            self.log_z[some] = most + np.log(np.exp((s - most[:, None]).astype(np.float32)).sum(1, dtype=np.float64))
        s = np.einsum("ij,ij->i", self.near[h[:, 0]] + self.far[h[:, 1]], self.p.Q[classes]) + self.p.b[classes]
        return (s - self.log_z[pair]) / math.log(10)


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, p: Parameters) -> Scorer:
    """The process's scorer of a model: a worker keeps the last one's sums from task to task."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(p)
    return _SCORERS[name]


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Null texts count as empty: a text of one token, the end. Repeated rows are scored one by one
    and counted one by one. Without training rows both scores are 0. Other columns are ignored. A text
    of any length is gone through in portions. Counts and base scores don't depend on how rows are
    dealt to partitions; ``score`` does a little, as each partition trains on its rows and the parameters
    are averaged.
    """
    counts = materialize(count_words(training, text))
    words = vocabulary(counts)
    params = train(training, key, text, words)
    lift = np.log10(words.totals)
    log_n = math.log10(words.n + words.v + 1)
    v, name = words.v, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts, scorer, row = _Facts(words), _scorer(name, params), TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            size, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
            base, model = np.zeros(n), np.zeros(n)
            rare: dict[int, Counter] = {}
            done, held = 0, 0

            def finished(to: int) -> pa.RecordBatch:
                lists = [list(rare.pop(k, {}).items()) for k in range(done, to)]  # noqa: B023
                offsets = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
                flat = pa.StructArray.from_arrays([pa.array([w for x in lists for w, _ in x], pa.binary()), pa.array([k for x in lists for _, k in x], pa.int32())], names=["word", "tf"])
                columns = [pa.array(np.arange(row + done, row + to)), batch.column(0).slice(done, to - done), *[pa.array(x[done:to]) for x in (size, known, base, model)], pa.ListArray.from_arrays(offsets, flat)]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, names=["row", key, "n_tokens", "known", "base", "model", "rare"])

            for x in portions(utf8_list(batch.column(1)), facts):
                logs = scorer.logs(x.classes, x.h) if v else np.zeros(len(x.classes))
                seen, counted, starts = x.counts > 0, np.log10(x.counts + 1.0), x.starts
                logs = logs + np.where(x.classes >= OWN, counted - lift[x.classes], 0.0) if v else logs
                for total, one in ((size, np.ones(len(seen), np.int64)), (known, seen.astype(np.int64)), (base, counted), (model, logs)):
                    np.add.at(total, x.of, np.add.reduceat(one, starts))
                unseen = (~seen).tolist()
                for k, words_of, at in zip(x.of, x.words, starts, strict=True):
                    more = rare.setdefault(k, Counter())
                    had = len(more)
                    more.update(compress(words_of, unseen[at : at + len(words_of)]))
                    held += len(more) - had
                if held > RARE and x.ended:
                    yield finished(x.ended[-1] + 1)
                    done, held = x.ended[-1] + 1, sum(map(len, rare.values()))
            if done < n:
                yield finished(n)
            row += n

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(key, kind), *[T.StructField(x, T.LongType()) for x in ("n_tokens", "known")], *[T.StructField(x, T.DoubleType()) for x in ("base", "model")]])
    schema = schema.add("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("tf", T.IntegerType())])))
    parts = materialize(docs.select(key, text).mapInArrow(run, schema))
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    found = rare.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("x"))
    out = parts.drop("rare").join(found, "row", "left")
    x = F.coalesce("x", F.lit(0.0))
    return out.select(
        key,
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.n).cast("long").alias("train_tokens"),
        (F.col("base") + x - F.col("n_tokens") * F.lit(log_n)).alias("base_score"),
        (F.col("model") + x).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession, TEXTS)
    out = score(docs, docs.where(fold("doc_id", 7) != 2))
    return out.select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
