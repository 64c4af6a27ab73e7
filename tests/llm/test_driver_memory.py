"""What the models that are fitted on the driver hold in its memory."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from foliospark.llm import langid, sampling, toxicity
from foliospark.llm.common import materialize


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_holds_a_word_once():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    texts = ["\n".join(" ".join(rng.choices(words, k=20)) for _ in range(25)).encode() for _ in range(300)]
    toxic = [k % 2 == 0 for k in range(len(texts))]
    texts = [t + b" badword" * bad for t, bad in zip(texts, toxic, strict=True)]
    n = sum(len(t.split()) for t in texts)
    assert peak(lambda: toxicity.train(texts, toxic, 0.5)) < 100 * n  # 197 bytes a word when each was an object


def test_only_kept_rows_become_objects():
    n, size = 2000, 10
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 100, pa.int32()), pa.array(np.arange(n * 100) + 1000))
    table = pa.table({"k": pa.array(range(n)), sampling.HASH: pa.array([(7 * k) % n for k in range(n)]), "c": ["a", "b"] * (n // 2), "at": lists})
    got = []
    assert peak(lambda: got.extend(sampling.first(table, "k", size, "c"))) < 1_500_000
    kept = sorted(k for c in (0, 1) for k in sorted(range(c, n, 2), key=lambda k: (7 * k) % n)[:size])
    assert [r["k"] for r in got] == kept and got[0]["at"] == list(range(1000 + 100 * kept[0], 1100 + 100 * kept[0]))


def test_language_counts_stay_out_of_python(spark, monkeypatch):
    held = []
    monkeypatch.setattr(langid, "ftrl", lambda rows, y, n, *a: held.append(rows) or np.zeros((langid.DIM, n)))
    texts = ["the cat sat on the mat", "die katze sass auf der matte"] * 10
    docs = spark.createDataFrame([(k, t, "en" if k % 2 == 0 else "de") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for at, v in held[0]:
        which = [langid.counts(t) for t in texts[:2]]
        assert not at.flags.owndata  # a view of Arrow's buffer
        assert any(np.array_equal(at, a) and v == pytest.approx(langid.tfidf(a, n, model.idf)) for a, n in which)


def test_intermediate_tables_have_no_success_file(spark):
    table = materialize(spark.range(5))
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://"))
    assert table.count() == 5 and not [x for x in os.listdir(folder) if "_SUCCESS" in x]
