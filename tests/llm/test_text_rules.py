"""Rules, line dedup and packing against plain Python, with the edge cases of their docstrings."""

import random
from collections import Counter, defaultdict

import pytest

from foliospark.llm import line_dedup, packing, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


EDGE = [None, "", " \n\t", "a", "a b c a b c\na b c", "é " * 60, "x" * 5000, "# $ % word\n\nword\nword", "a b\x1cc d"]


def brute_rules(text):
    text = text or ""
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines))


def test_rules_match_brute_force(spark):
    rng = random.Random(1)
    texts = EDGE + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(200))) for _ in range(30)]
    docs = table(spark, [(k, t, "s") for k, t in enumerate(texts)]).selectExpr("*", "1 AS n_words", "'x' AS kept")
    got = rules.apply_policy(rules.ledger(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in rules.MEASURES) == brute_rules(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    out = {r["rule"]: r for r in rules.ablations(rules.ledger(docs)).collect()}
    assert out["too_short"]["failed"] == sum(r["n_words"] < 50 for r in got)
    assert out["symbols"]["failed_alone"] == sum(r["fail_bits"] == 8 for r in got)


def test_rules_on_an_empty_table(spark):
    empty = table(spark, [])
    assert rules.query(empty).count() == 0
    assert all(r["failed"] == 0 for r in rules.ablations(rules.ledger(empty)).collect())


def test_line_dedup_drops_a_hosts_boilerplate_only(spark):
    rows = [(k, f"menu \nown line {k}\n\nmenu", "a") for k in range(20)]
    rows += [(100 + k, f"menu\nother {k}", "b") for k in range(4)]
    rows += [(150, "menu\nonly page", "single")]
    rows += [(200, None, "a"), (201, "", "a"), (202, "menu", None), (203, "menu", "a"), (203, "menu", "a")]
    got = defaultdict(list)
    for r in line_dedup.drop_boilerplate(table(spark, rows).selectExpr("*", "9 AS n_dropped")).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert got[3][0]["text"] == "own line 3\n" and got[3][0]["n_dropped"] == 2 and got[3][0]["n_chars"] == 11
    assert got[101][0]["text"] == "other 1"  # four pages of four
    assert got[150][0]["text"] == "menu\nonly page"  # nothing repeats on one page
    assert got[200][0]["text"] is None and got[200][0]["n_lines"] == 0
    assert got[201][0]["text"] == "" and got[202][0]["text"] == "menu"
    assert [r["text"] for r in got[203]] == ["", ""]
    assert line_dedup.query(table(spark, [])).count() == 0


def test_hosts_of_urls_and_very_long_pages(spark):
    rows = [(k, f"https://User@Example.org:80/p{k}?q#f", "menu\n" + "\n".join(f"l{k} {j}" for j in range(3000))) for k in range(3)] + [(9, "no url", "menu"), (10, None, "menu")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", line_dedup.host_of("url"))
    got = {r["page_id"]: r for r in line_dedup.drop_boilerplate(docs, "host", "html").collect()}
    assert got[0]["host"] == "example.org" and got[9]["host"] is None
    assert all(got[k]["n_lines"] == 3001 and got[k]["n_dropped"] == 1 and got[k]["html"].startswith("l") for k in range(3))
    assert got[9]["html"] == got[10]["html"] == ""  # pages without a host are a host of their own


def test_packing_over_several_shards_and_given_clusters(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 16)
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 40)) + f" {k}", rng.choice("abcdefgh")) for k in range(150)] + [(900, "w " * 200, "z")]
    docs = table(spark, rows).selectExpr("*", "doc_id % 50 AS component_id", "1 AS bin_id", "'x' AS piece")
    got = packing.pack(docs, capacity=32, cluster="component_id").collect()
    assert len({r["bin_id"] >> 32 for r in got}) > 3
    words, bins = Counter(), defaultdict(list)
    for r in got:
        words[r["doc_id"]] += r["n_words"]
        bins[r["bin_id"]].append(r)
    assert all(words[i] == len(t.split()) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    for rs in bins.values():
        assert sum(r["n_words"] for r in rs) == rs[0]["bin_words"] <= 32
        assert len({source[r["doc_id"]] for r in rs}) == len({r["doc_id"] % 50 for r in rs}) == len(rs)
    again = packing.pack(docs.repartition(7), capacity=32, cluster="component_id").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))  # the layout of the input changes nothing


@pytest.mark.parametrize("capacity", [5, 64])
def test_packing_keeps_every_word_and_no_conflict(spark, capacity):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.randrange(0, 3 * capacity)) + f" {k % 7}", rng.choice(["hot", "hot", "b", None])) for k in range(300)] + [(300, None, "b"), (301, "", "c")]
    docs = table(spark, rows)
    got = packing.pack(docs, capacity=capacity).collect()
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    held = defaultdict(list)
    words = Counter()
    for r in got:
        held[r["bin_id"]].append(r)
        words[r["doc_id"]] += r["n_words"]
        assert r["start_word"] == r["piece"] * capacity
    assert all(words[i] == len((t or "").split()) for i, t in text.items())
    for rs in held.values():
        assert sum(r["n_words"] for r in rs) == rs[0]["bin_words"] <= capacity
        assert len({source[r["doc_id"]] for r in rs}) == len(rs) == len({text[r["doc_id"]] or "" for r in rs})
    assert packing.pack(table(spark, [])).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # bins of residual 4 and 2 after two pieces; the third fits the tighter one, the fourth conflicts there
    assert packing.best_fit([6, 8, 2, 2], [0, 1, 2, 1], [0, 1, 2, 3], 10) == [0, 1, 1, 0]

    def slow(sizes, sources, clusters, capacity):
        bins, out = [], []
        for s, a, c in zip(sizes, sources, clusters, strict=True):
            able = [(b[0], k) for k, b in enumerate(bins) if b[0] >= s and a not in b[1] and c not in b[2]]
            k = min(able)[1] if able else len(bins)
            if not able:
                bins.append([capacity, set(), set()])
            bins[k][0] -= s
            bins[k][1].add(a)
            bins[k][2].add(c)
            out.append(k)
        return out

    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 80)
        args = ([rng.randrange(0, 20) for _ in range(n)], [rng.randrange(5) for _ in range(n)], [rng.randrange(30) for _ in range(n)], 20)
        assert packing.best_fit(*args) == slow(*args)
