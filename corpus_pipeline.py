"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It is written as Parquet and read
back as the next stage's docs. All but the last return the columns of documents.

For all stages: a repeated row is a row of its own and goes or stays like its copies; an empty table gives an
empty table; columns beside those of documents are carried on, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import langid, line_dedup, minhash, packing, toxicity
from foliospark.llm.common import documents, labels, materialize, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those predicted toxic. Null and empty texts hold no toxic word and stay; without labels of
    both classes a document is as toxic as labelled rows are on average, so all stay or all go. A null id stays
    by its text."""
    small_batches(spark)
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less those without an identified language: null and empty texts, texts without a letter, and those
    that the model is less than half sure of. A null lang is no label; where no row has one, all go."""
    small_batches(spark)
    return langid.keep_identified(docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text. A null text stays
    null, one whose lines all go becomes empty, rows of a null source are a host of their own."""
    small_batches(spark)
    return line_dedup.stripped(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles, the one of the smallest id. Null and empty
    texts and null ids are in no group and stay; rows of one id are one document."""
    small_batches(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document, with its bin. Null and empty texts are a piece of no words; longer texts than
    a bin are cut, and no word is lost. A bin holds no two pieces of one source or of equal texts; near copies
    are gone by now."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

#: The first stages are fitted models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
