"""Shared pieces of the training-data operators: words, Arrow mapping, shared storage.

Words are the maximal runs of bytes outside space and 0x09-0x0D, which is what
``bytes.split()`` yields on UTF-8; no multi-byte sequence holds such a byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.sources.storage import spread, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def materialize(df: DataFrame, rows: int | None = None, a_task: int = 50_000) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and outlives executors.

    With ``rows``, a bound of what the last stage goes through, by no more tasks than have ``a_task`` rows
    each: tables of few rows are few files, whatever the number of shuffle partitions.
    """
    return written(df if rows is None else df.coalesce(max(1, -(-rows // a_task))))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, so that long texts fit a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def fold(key: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % F.lit(modulus)


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """True for the held-out fold; a null id belongs to no fold, so it is false."""
    return F.coalesce(fold(key, modulus) == remainder, F.lit(False))


def utf8_list(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, a null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns an operator is about to add, compared without case as Spark does."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def map_texts(
    df: DataFrame,
    text: str,
    carry: list[str],
    added: T.StructType,
    kernel: Callable[[list[bytes]], list],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Columns ``carry`` of df followed by ``added``, which ``kernel`` computes from the texts of a batch.

    The kernel gets UTF-8 texts (null as empty) and returns one sequence for each added
    column. With ``setup`` it gets setup()'s value, made once in a task, as second argument.
    """
    carry = [c for c in carry if c.lower() not in {f.name.lower() for f in added}]
    inner = "__text"
    while inner in {c.lower() for c in carry}:
        inner += "_"
    source = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias(inner))
    schema = T.StructType([*source.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(added)
        state = setup() if setup else None
        for batch in batches:
            texts = utf8_list(batch.column(batch.num_columns - 1))
            columns = kernel(texts, state) if setup else kernel(texts)
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(columns, types, strict=True)]
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*batch.schema.names[:-1], *types.names])

    return source.mapInArrow(run, schema)
