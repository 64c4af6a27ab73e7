"""Byte-level BPE against the reference library, and I-Match fingerprints against plain Python."""

import base64
import hashlib
import random

import pytest

from foliospark.llm import bpe, imatch

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
TEXTS = [None, "", " ", "a", "Hello, world's  end\n\n\tx", "<|endoftext|>", "naïve éè ñ 日本語 \U0001f600", "a" * 3000, "xyzzy" * 500, "\x00\x1c  b", "12345 67,89", "password=5aaa9ac60bfe74b24b", "the the the"]


@pytest.fixture(scope="module")
def library():
    path = P.path(bpe.VOCABULARY)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, library):
    path, enc = library
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("abcdeé 's.,1\n") for _ in range(rng.randrange(300))) for _ in range(60)] + ["the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    rows = bpe.encode(docs, path, P.PATTERN)
    back = bpe.decode(rows, path, P.PATTERN).collect()
    assert len(back) == len(texts)
    for r in back:
        want = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    for r in bpe.query(docs).collect():
        want = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(enc.decode_bytes(want)).hexdigest()
    assert bpe.query(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long", [0, 3, 400])
def test_both_recursions_agree_with_the_library(library, monkeypatch, long):
    path, enc = library
    own = bpe.Codec(path, P.PATTERN)
    monkeypatch.setattr(bpe, "LONG_PIECE", long)
    rng = random.Random(9)
    texts = ["internationalisation", "aaaaaaaaab", "ababababab", "ééééé", "a" * 2000, "ab" * 700]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "日本語テスト") for n in (7, 450, 900)]
    for t, x in zip(texts, own.encode(texts), strict=True):
        assert [int(k) for p in x for k in p[1].split()] == enc.encode_ordinary(t)
        assert b"".join(p[2] for p in x) == t.encode()


def corpus():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(3 * k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 80)))) for k in range(120)]
    return [*rows, (1000, None), (1001, ""), (1002, "é"), (1003, rows[5][1]), (None, "a b c")]


def test_edited_texts_and_likeness(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    got = imatch.query(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    text = {i: t or "" for i, t in rows}
    after = {order[k][0]: order[(k + 1) % len(order)][0] for k in range(len(order))}
    prints = {}
    for r in got:
        t = text[r["doc_id"]]
        half = len(t) // 2
        changed = t[: len(t) - half] + text[after[r["doc_id"]]][:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (r["near_edited"] == 1)
        prints[r["doc_id"]] = r["fingerprint"]
    assert prints[1003] == prints[15] and prints[1000] == prints[1001]
    long = [r for r in got if r["n_chars"] > 100]
    assert sum(r["near_edited"] for r in long) > 2 * sum(r["near_next"] for r in long)


def test_slots_hash_sorted_band_terms(spark):
    """A slot depends on the set of its terms in the band only: not on their order, number or case, nor on other terms."""
    docs = spark.createDataFrame([(k, " ".join(f"t{j}" for j in range(40) if (k >> (j % 5)) & 1 or j % 7 == k % 7)) for k in range(200)], "doc_id long, text string")
    band = imatch.lexicon(docs, least=100, most=9900)
    assert len(band.hashes) == 40
    pair = spark.createDataFrame([(1, "t1 t2 t3 t8", "T8 zzz t3 t2\nt1 t1"), (2, "t1 t2", "t1 t3")], "key long, x string, y string")
    got = {r["key"]: r for r in imatch.fingerprint(imatch.fingerprint(pair, "x", band, "a"), "y", band, "b").collect()}
    assert got[1]["a"] == got[1]["b"] and got[2]["a"] != got[2]["b"]


def test_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "longer text here"), (0, "zz")], "doc_id long, text string")
    got = imatch.query(docs).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 1, 1]
    assert len({r["fingerprint"] for r in got if r["n_chars"] == 5}) == 1
    one = imatch.query(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert imatch.query(docs.limit(0)).count() == 0
