"""Reachability: in one document's objects, and over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.pdf import Document, refs_of
from foliospark.sources.pdfsyntax import Ref, Stream
from foliospark.sources.storage import written

FOLD = 8


def reachable(doc: Document) -> set[int]:
    """Numbers of the objects that the trailer's Root and Info lead to."""
    todo = [v.num for k in ("Root", "Info") if isinstance(v := doc.trailer.get(k), Ref)]
    seen: set[int] = set()
    while todo:
        num = todo.pop()
        if num not in seen and num in doc.objects:
            seen.add(num)
            todo += refs_of(doc.objects[num])
    return seen


def prune(doc: Document) -> int:
    """Takes unreachable objects out of doc; returns how many."""
    kept = reachable(doc)
    gone = len(doc.objects) - len(kept)
    doc.objects = {n: v for n, v in doc.objects.items() if n in kept}
    return gone


def rewritten(v, to: dict[int, int]):
    """v with references to the keys of ``to`` replaced."""
    if isinstance(v, Ref):
        return Ref(to[v.num], 0) if v.num in to else v
    if isinstance(v, Stream):
        return Stream(rewritten(v.dict, to), v.data)
    if isinstance(v, dict):
        return {k: rewritten(x, to) for k, x in v.items()}
    return [rewritten(x, to) for x in v] if isinstance(v, list) else v


def closure(edges: DataFrame, roots: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Nodes that roots (node) lead to over edges (src, dst), roots included; ends on cycles too.

    Breadth first: each round joins the last round's new nodes only. Edges are written once, and rounds to
    the shared folder; every FOLD rounds the nodes seen are written as one table, so plans stay short, and
    all outlives lost executors. Nulls are ignored.
    """
    edges = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    front = written(roots.select("node").where("node IS NOT NULL").distinct())
    seen = front
    for k in range(rounds):
        if front.isEmpty():
            return seen
        reached = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti"))
        seen = seen.unionAll(front) if k % FOLD else written(seen.unionAll(front))
    raise RuntimeError(f"no fixpoint within {rounds} rounds")
