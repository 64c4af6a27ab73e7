"""Bounded samples of rows by the hash of their key, for models that are fitted on the driver.

A class of n keys is cut at the hash that lets through the sample's size and a margin, so no
class goes through one task: the cut is a filter, and what little passes is ordered on the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "__hash"


def _bound(n: int, size: int) -> int:
    """The hash under which about ``size`` of n keys lie; more by six deviations and the count's error."""
    share = min(1.0, 1.2 * (size + 6 * size**0.5) / max(n, 1))
    return min(2**63 - 1, int(-(2**63) + share * 2**64))


def drawn(rows: DataFrame, key: str, size: int, label: str | None = None) -> DataFrame:
    """Rows with a key (and a label) whose key's hash, column HASH, is under the bound of their class.

    Few more than ``size`` keys a class pass; ``first`` cuts to it. Repeated keys count once. The
    number of classes must be small enough for the driver, as it is for the model's outputs.
    """
    rows = rows.where(F.col(key).isNotNull()).withColumn(HASH, F.xxhash64(key))
    keys = F.approx_count_distinct(key, 0.03).alias("n")
    if label is None:
        return rows.where(F.col(HASH) <= F.lit(_bound(rows.agg(keys).first()["n"], size)))
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(keys).collect()
    under: Column = F.lit(False)
    for r in counts:
        under = under | ((F.col(label) == F.lit(r[label])) & (F.col(HASH) <= F.lit(_bound(r["n"], size))))
    return rows.where(under)


def texts_of(docs: DataFrame, sample: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key, label, HASH, text) of the documents with a drawn key: one row a key and label, its least text.

    A sample has few more keys than its size, which bounds the broadcast."""
    ids = sample.select(F.col(key).alias("__key"), F.col(label).alias("__label"), HASH).distinct()
    rows = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(ids), F.col("__k") == F.col("__key"))
    return one_a_key(rows.select(F.col("__key").alias(key), F.col("__label").alias(label), HASH, F.col("__t").alias(text)), text)


def one_a_key(rows: DataFrame, text: str) -> DataFrame:
    """Rows equal but for their text as one, of the least text; partial minima meet before any shuffle."""
    others = [c for c in rows.columns if c != text]
    return rows.groupBy(*[F.col(f"`{c}`") for c in others]).agg(F.min(F.col(f"`{text}`")).alias(text))


def places(table: pa.Table, key: str, size: int, label: str | None = None) -> list[int]:
    """The places of the rows of the ``size`` least hashes of each class, in the order of label and key."""
    keys, hashes = table[key].to_pylist(), table[HASH].to_pylist()
    classes = table[label].to_pylist() if label else [None] * len(keys)
    n: dict = {}
    kept = []
    for i in sorted(range(len(keys)), key=lambda i: (hashes[i], str(keys[i]))):
        n[classes[i]] = n.get(classes[i], 0) + 1
        if n[classes[i]] <= size:
            kept.append(i)
    return sorted(kept, key=lambda i: (keys[i], str(classes[i]) if label else ""))


def first(table: pa.Table, key: str, size: int, label: str | None = None) -> list[dict]:
    """The rows at ``places``; of the others no Python objects are made."""
    return table.take(pa.array(places(table, key, size, label), pa.int64())).to_pylist()
