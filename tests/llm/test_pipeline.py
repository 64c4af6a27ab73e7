import random

import corpus_pipeline
from foliospark.llm import queries
from tests.llm.test_models import corpus


def test_stages_return_documents_and_run_ends_packed(spark, tmp_path):
    rows, labels = corpus(300, 3)
    copies = [(1000 + k, rows[k][1], rows[k][2], "s") for k in range(40)]
    every = [(i, t, x, s, len(t)) for i, t, x, s in rows + copies] + [(5000, None, None, None, None), (5001, "", "aa", "s", 0)]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    toxic = {i for i, _, bad in labels if bad}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
            break
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = {r["doc_id"] for r in docs.collect()}, spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert len(after & toxic) < 0.1 * len(toxic) and len(before - after - toxic - {1000 + x for x in toxic}) < 10
        if name == "language_id":
            assert 5000 not in after and 5001 not in after
        if name == "near_dedup":
            assert not any(k + 1000 in after for k in range(40) if k in after)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_stages_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_with_clashing_columns_nulls_ties_and_long_texts(spark, tmp_path):
    rows, labels = corpus(200, 5)
    rng = random.Random(4)
    clean = " ".join("".join(rng.choice(["ka", "to", "mi", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(25_000))
    every = [(i, t, x, s, len(t)) for i, t, x, s in rows] + [(7000, clean, "aa", "s", 1), (None, rows[1][1], "aa", None, None), (7001, "ka\nka\nmi", None, None, None)]
    every += every[:3]  # repeated rows
    docs = spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS score", "'x' AS predicted", "2 AS spans", "3 AS lang_pred", "4 AS n_lines", "5 AS n_dropped", "6 AS component_id", "7 AS kept", "8 AS __text", "9 AS bin_id", "10 AS __lines")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k == len(corpus_pipeline.STAGES) - 1:
            words = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg({"n_words": "sum"}).withColumnRenamed("sum(n_words)", "n").collect()}
            assert words[7000] > 20_000
            break
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.where("predicted = 'x' AND kept = 7 AND __text = 8 AND n_lines = 4 AND __lines = 10 AND component_id = 6").count() == docs.count() > 0
        assert docs.where("doc_id = 7000").count() == 1, name
