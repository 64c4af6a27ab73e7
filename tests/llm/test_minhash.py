import random

import pytest

from foliospark.llm import minhash
from foliospark.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string"


def brute(rows, k, percent):
    def cut(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[ \t-\r]+", low) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = [(i, cut(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (find(i) if i is not None else None) for i, _ in rows}, {i: len(s) for i, s in sets}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 120, 300]))]
        for _ in range(1 + family % 6 * 4):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 20) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((n, (" " if n % 2 else "\n").join(w).upper() if n % 3 else " ".join(w)))
            n += 1
    return [*rows, (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "x" * 20000)]


def test_groups_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA).selectExpr("*", "'x' AS component_id", "0 AS a")
    for k, percent in ((3, 85), (5, 80)):
        want, sizes = brute(rows, k, percent)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, k=k, percent=percent).collect()}
        assert len(got) == len(rows)
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


@pytest.mark.parametrize("hubs", [1, 4])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, hubs):
    """Groups of over three blocks, some of whose members no hub links: a chain of small steps."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 4)
    monkeypatch.setattr(minhash, "HUBS", hubs)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = corpus()
    chain = [f"c{k}" for k in range(200)]
    for step in range(24):
        rows.append((3000 + step * 37 % 24, " ".join(chain)))
        for k in range(4):
            chain[(step * 8 + k) % 200] = f"new{step}x{k}"
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k=3, percent=85).collect()} == brute(rows, 3, 85)[0]


def test_null_and_repeated_keys(spark):
    long = " ".join(f"t{k}" for k in range(40))
    docs = spark.createDataFrame([(None, long, "s"), (7, long, "s"), (7, "other words are here", "s"), (9, "other words are here", "s"), (9, "other words are here", "s")], SCHEMA)
    got = sorted(((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (9, 7, False)], key=str)
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 7, 7]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 540)]
    cycle = [(900, 901), (901, 902), (902, 900), (900, 900), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + star + cycle, "u long, v long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(500, 540)} == {500} and {got[k] for k in (900, 901, 902)} == {900}
    assert len(got) == 61 + 40 + 3
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
