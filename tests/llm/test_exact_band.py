"""The band of I-Match and its fingerprints against a plain version with hashes of its own."""

import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliospark.llm import imatch


def signed(x, bits=64):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def xx(data, seed=42):
    return signed(xxhash.xxh64_intdigest(data, seed & (2**64 - 1)))


def murmur(x, seed):
    """Murmur3 of one long in two halves."""
    mask, rot = 0xFFFFFFFF, lambda v, n: ((v << n) | (v >> (32 - n))) & 0xFFFFFFFF
    h = seed & mask
    for half in (x & mask, (x >> 32) & mask):
        h = (rot(h ^ (rot(half * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    h ^= 8
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return signed(h ^ (h >> 16), 32)


def hashed(terms):
    h = 42
    for t in terms:
        h = murmur(t, h)
    return h


def plain_slots(text, band):
    terms = sorted({h for h in map(lambda w: xx(w.encode()), __import__("re").split("[ \t-\r]+", text.lower())) if h in band})
    if not terms:
        terms = [xx(b"whole", xx(text.encode()))]
    out = [hashed(terms)]
    for rate in range(2, 10):
        seeded = [xx(struct.pack("<i", rate), xx(struct.pack("<q", t))) for t in terms]
        out += [hashed([x for x in seeded if (x >> (10 * j)) & ((1 << rate) - 1) == 0]) for j in range(6)]
    return out


def plain_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if not x == y == 42]
    return sum(x == y for x, y in pairs) / max(1, len(pairs))


def written(slots):
    return ":".join("" if x == 42 else f"{x & 0xFFFFFFFF:x}" for x in slots)


def test_terms_that_share_a_place_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(imatch, "BITS", 6)  # 64 places: rare words fill them all
    rows = [(k, " ".join(f"t{j}" for j in range(30) if k % 10 == j % 10) + f" rare{k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in imatch.query(docs).collect()}
    # texts of one tenth differ in a word far outside the band only
    for k in range(10):
        assert len({got[i]["fingerprint"] for i in range(k, 1000, 10)}) == 1
    assert len({r["fingerprint"] for r in got.values()}) == 10


@pytest.mark.parametrize("bits", [3, 19])
def test_the_band_is_exact_though_places_are_few(spark, monkeypatch, bits):
    """With eight places in each bitmap nearly all terms pass them; the list beside sets that right."""
    monkeypatch.setattr(imatch, "BITS", max(bits, 6))
    docs = [(k, " ".join([*(f"t{j}" for j in range(30) if k % (j + 2) == 0), f"own{k}", "always"])) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = imatch.lexicon(df, least=200, most=2000)
    counts = {}
    for _, t in docs:
        for w in set(t.split()):
            counts[w] = counts.get(w, 0) + 1
    want = {xx(w.encode()) for w, n in counts.items() if n * 10000 >= 120 * 200 and n * 10000 <= 120 * 2000}
    assert set(found.hashes.tolist()) == want and want
    every = spark.createDataFrame([(xx(w.encode()),) for w in counts], "h long")
    assert {r["h"] for r in every.where(found.holds(every["h"])).collect()} == want
    if bits == 3:
        assert len(found.outside)


def test_fingerprints_and_likeness_are_those_of_the_definition(spark):
    rng = random.Random(11)
    words = [f"W{k}é" if k % 9 == 0 else f"w{k}" for k in range(150)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 70)))) for k in range(60)] + [(100, None), (101, ""), (102, "rare only"), (103, "a\x1cb \n w1")]
    rows = {r["doc_id"]: r for r in imatch.query(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = {i: t or "" for i, t in docs}
    split = lambda t: set(__import__("re").split("[ \t-\r]+", t.lower())) - {""}
    counts = {}
    for t in text.values():
        for w in split(t):
            counts[w] = counts.get(w, 0) + 1
    band = {xx(w.encode()) for w, n in counts.items() if imatch.LEAST * len(docs) <= n * 10000 <= imatch.MOST * len(docs)}
    order = sorted(text, reverse=True)
    for at, i in enumerate(order):
        following, half = text[order[(at + 1) % len(order)]], len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + following[:half]
        own, changed, after = (plain_slots(t, band) for t in (text[i], edited, following))
        assert rows[i]["fingerprint"] == written(own) and rows[i]["edited_fingerprint"] == written(changed)
        assert rows[i]["near_edited"] == pytest.approx(plain_likeness(own, changed)) and rows[i]["near_next"] == pytest.approx(plain_likeness(own, after))


def test_places_of_a_hash_do_not_overlap():
    h = np.int64(-1)
    assert imatch.PLACES * 20 <= 64 and (int(h) >> 40) & ((1 << imatch.BITS) - 1) == (1 << imatch.BITS) - 1


def test_more_documents_than_an_integer_product_holds(spark):
    n = 1_100_000  # n * MOST is over 2 ** 31
    terms = F.concat_ws(" ", F.concat(F.lit("often"), F.col("id") % 3), F.concat(F.lit("band"), F.col("id") % 300), F.concat(F.lit("rare"), F.col("id") % 5000))
    found = imatch.lexicon(spark.range(n).select(terms.alias("text")))
    assert set(found.hashes.tolist()) == {xx(f"band{k}".encode()) for k in range(300)}
