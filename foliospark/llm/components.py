"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import materialize

#: Edges a task of a round has at least.
EDGES = 2_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges with u > v: neighbours are hung on the least node that their centre sees."""
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node on an edge (u, v); component is the least node reachable.

    Self-loops, repeated edges and edges with a null end are ignored. Each round is written to
    the shared folder; the number of rounds grows with the logarithm of a component's size.
    """
    kind = edges.schema["u"].dataType
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").cast(kind).alias("v")).distinct()
    seen = None
    edges = materialize(edges)
    for _ in range(rounds):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if tuple(state) == seen or not state["n"]:
            break
        seen = tuple(state)
        edges = materialize(_stars(_stars(edges, True), False), state["n"], EDGES)
    else:
        raise RuntimeError(f"no fixpoint within {rounds} rounds")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
