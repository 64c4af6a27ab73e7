"""Best-fit packing of documents into training sequences, under conflicts.

Bins stand in the order of their residual room. Each carries a bitmap of the sources and
one of the duplicate clusters it holds. A piece goes to the tightest bin with room that has
neither its source nor its cluster: the search starts at the first bin with room enough and
goes on to the successors until one is compatible, else it opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, materialize

CAPACITY = 2048
#: Pieces packed together. A search passes at most this many bins, so work is linear in the table.
SHARD = 4096


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin numbers of pieces, placed in the order given."""
    order: list[tuple[int, int]] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = 1 << source, 1 << cluster
        at = bisect_left(order, (size, -1))
        while at < len(order) and (source_bits[order[at][1]] & s or cluster_bits[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(source_bits)
            source_bits.append(0)
            cluster_bits.append(0)
        source_bits[b] |= s
        cluster_bits[b] |= c
        insort(order, (residual - size, b))
        placed.append(b)
    return placed


def pieces(docs: DataFrame, key: str, text: str, source: str, capacity: int, cluster: str | None = None) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.coalesce(F.col(text), F.lit("")) if cluster is None else F.col(cluster)).alias("cluster"), words.alias("total"))
    count = F.greatest(F.lit(1), F.ceil(F.col("total") / capacity)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("long") * capacity
    return rows.select("doc_id", "source", "cluster", "piece", start.alias("start_word"), F.least(F.col("total") - start, F.lit(capacity)).alias("n_words"))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, cluster: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start_word, n_words, bin_id, bin_words.

    A text of more words than ``capacity`` is cut into full pieces and a rest; no word is lost.
    No bin holds more than ``capacity`` words, two pieces of one source, or two pieces of one
    duplicate cluster: rows of one value of ``cluster``, such as component_id of
    near-duplicates, or equal texts where no column is named. Null and empty texts are one piece of no words, and equal
    texts of each other; null sources count as one source. Repeated rows are packed one by one.
    Pieces are dealt by hash into shards of about SHARD and packed largest first within one,
    ties by id, piece and cluster; a hot source meets a bounded number of bins in each shard.
    Other columns of docs are ignored.
    """
    rows = materialize(pieces(docs, key, text, source, capacity, cluster))
    shards = max(1, -(-rows.count() // SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster"), F.lit(shards)))

    def shard(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        codes = [pd.factorize(part[c], use_na_sentinel=False)[0].tolist() for c in ("source", "cluster")]
        bins = np.array(best_fit(part["n_words"].tolist(), *codes, capacity), np.int64)
        fill = np.bincount(bins, weights=part["n_words"]).astype(np.int64)
        out = part[["doc_id", "piece", "start_word", "n_words"]].copy()
        out["bin_id"] = part["shard"].astype(np.int64) * 2**32 + bins
        out["bin_words"] = fill[bins]
        return out

    kind = dict(rows.dtypes)["doc_id"]
    return rows.groupBy("shard").applyInPandas(shard, f"doc_id {kind}, piece int, start_word long, n_words long, bin_id long, bin_words long")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)
