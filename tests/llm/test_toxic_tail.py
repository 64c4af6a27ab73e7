"""Toxic words that are each in few toxic documents, and copies told apart pair by pair."""

import random
import zlib

import numpy as np

from foliospark.llm import toxicity


def test_a_long_tail_of_toxic_words_is_learned():
    rng = random.Random(7)
    plain = [f"{a}{b}{c}" for a in "bdfg" for b in ("ala", "emo", "iru") for c in ("nt", "sk", "rp", "ld")]
    tail = [f"{a}{b}zz{k}" for k, (a, b) in enumerate((a, b) for a in ("kwa", "pli", "vro", "zeu", "hny") for b in "abcdefghijklmnopqrst")]

    def text(word=None):
        w = [rng.choice(plain) for _ in range(60)]
        return " ".join([*w[:30], word, *w[30:]] if word else w).encode()

    toxic = [text(w) for w in tail for _ in range(8)]  # each in 1 % of 800
    model = toxicity.train(toxic + [text() for _ in toxic], [True] * len(toxic) + [False] * len(toxic), 0.5)
    new = [text(w) for w in tail] + [text() for _ in tail]
    words, lengths, per_text = toxicity._chains(new)
    p, _, _ = toxicity.marginals(np.array([model.potential(w) for w in words]), lengths, model.trans)
    marked = 1 / (1 + np.exp(-toxicity.summary(p, per_text) @ model.calibration)) >= toxicity.THRESHOLD
    assert marked[: len(tail)].mean() > 0.95 and marked[len(tail) :].mean() < 0.05


def test_a_text_is_a_copy_of_one_text_only():
    def sketch(t):
        w = t.split()
        return sorted({zlib.crc32(b" ".join(w[i : i + 3])) for i in range(len(w) - 2)})[:8]

    text = b" ".join(b"w%d" % k for k in range(40))
    grams = {zlib.crc32(b" ".join(text.split()[i : i + 3])): b" ".join(text.split()[i : i + 3]) for i in range(38)}
    before = [grams[h] for h in sketch(text)[:4]]  # four texts of three words, each with one of its hashes
    assert toxicity.without_copies([*before, text, text + b" more"]) == [0, 1, 2, 3, 4]
