"""Near-duplicate groups by MinHash with tensored banding, verified on full shingle sets.

A document gets two small collections of ``side`` minhash tuples of ``half`` values each.
The key of table (i, j) joins tuple i of the first with tuple j of the second, so side * side
tables of 2 * half values come from 2 * side * half minhashes. Two sets of Jaccard similarity s
meet in some table with probability (1 - (1 - s**half)**side)**2.

Documents of equal sets, by a 128-bit cryptographic digest of the full sorted set, are one class
and only its representative is hashed into tables. Representatives that meet somebody are
compared in units: the groups that share tuple i of the first collection. A unit checks, on the
full sets, each of its pairs that share a table there and met in no earlier group, and returns a
spanning forest of the links, so neither pairs nor links of a large group are ever listed.

A large group is cut into blocks. Each block holds its members and the group's hubs, a few
members that go to all blocks, so what is linked to a hub is one tree at once. Only members that are
then outside the group's largest tree meet the other blocks. So sets are copied as often as there
are hubs and members left, not as there are blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import LOWER, map_texts, materialize
from foliospark.llm.components import connected_components

HALF = 3
#: A pair at the threshold itself is missed with this chance at most.
MISSED = 3e-5
#: Limits of one block of a unit: documents and shingles; and members that meet every block of a group.
BLOCK_DOCS = 1024
BLOCK_SHINGLES = 1 << 21
HUBS = 4
#: Sets that a task compares, and texts that it reads, at least, however many small partitions there are.
SETS, TEXTS = 2_000, 5_000
#: Ids up to this many (12 MB) are broadcast to pick out documents; more are joined by shuffle.
BROADCAST_IDS = 500_000

_U = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)


def sides(percent: int, half: int = HALF) -> int:
    """Tuples a collection, so that a pair of this similarity meets in some table but for MISSED."""
    return math.ceil(math.log(MISSED / 2) / math.log1p(-((percent / 100) ** half))) if percent < 100 else 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: bytes, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words where there are fewer."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    k = min(k, len(words))
    total = np.full(len(h) - k + 1, k, _U)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _PLACE[j]
    s = np.sort(_mixed(total).view(np.int64))
    return s[np.r_[True, s[1:] != s[:-1]]]


def _tuples(sets: list[np.ndarray], half: int, side: int) -> np.ndarray:
    """2 * side minhash tuples of each set; zeros for an empty set."""
    out = np.zeros((len(sets), 2 * side), _U)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full]).view(_U)
        starts = np.cumsum([0, *[len(sets[k]) for k in full[:-1]]])
        factors = np.random.default_rng(20240229).integers(1, 2**63, 2 * side * half, dtype=_U) * _U(2) + _U(1)
        for t in range(2 * side):
            value = np.full(len(full), t, _U)
            for factor in factors[t * half : (t + 1) * half]:
                value = _mixed(value * _PLACE[0] + np.minimum.reduceat(flat * factor, starts))
            out[full, t] = value
    return out.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64)))


def _kernel(k: int, half: int, side: int, with_sets: bool):
    def run(texts: list[bytes]) -> list:
        hashes = _WordHashes()
        sets = [shingles(x, k, hashes) for x in texts]
        tuples = _tuples(sets, half, side)
        columns = [_lists(list(tuples[:, :side])), _lists(list(tuples[:, side:]))]
        if with_sets:
            return [*columns, _lists(sets)]
        digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
        return [[len(s) for s in sets], digests[:, 0], digests[:, 1], *columns]

    return run


_LONGS = T.ArrayType(T.LongType(), False)


class _Forest:
    """Links of one unit: labels of its rows, and the links that joined two labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, x: int, y: int) -> None:
        a, b = self.label[x], self.label[y]
        if a != b:
            self.label[self.label == b] = a
            self.links.append((x, y))


def _unit_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, group: int, xs: np.ndarray, able_with: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links of one unit that join two of its trees: of rows xs with all later rows, or where given with
    the rows that able_with says."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    marked = np.zeros(int(flat.max()) + 1, bool)
    forest = _Forest(n)
    for x in xs:
        start = 0 if able_with is not None else x + 1
        ys = np.arange(start, n)
        able = (b[ys] == b[x]).any(1) & (np.minimum(sizes[ys], sizes[x]) * 100 >= np.maximum(sizes[ys], sizes[x]) * percent)
        able &= forest.label[ys] != forest.label[x]
        if group:
            able &= ~(a[ys, :group] == a[x, :group]).any(1)
        if able_with is not None:
            able &= able_with[x]
        ys = ys[able]
        if not len(ys):
            continue
        marked[parts[x]] = True
        shared = np.add.reduceat(marked[np.concatenate([parts[y] for y in ys])].astype(np.int64), np.cumsum([0, *sizes[ys[:-1]]]))
        marked[parts[x]] = False
        for y in ys[100 * shared >= percent * (sizes[x] + sizes[ys] - shared)]:
            forest.join(x, int(y))
    return forest.links


_UNIT = ["g", "block", "rest"]


def _verify(percent: int):
    """Rows sorted by unit to links; a unit may go over several batches.

    In a unit of the first pass (rest is -1) all pairs are compared. In one of the second, rows that
    play x are compared with rows that play y and are of another tree; a pair that could be met twice
    is met where the smaller id plays x.
    """

    def unit_of(batch: pa.RecordBatch, at: int) -> list:
        return [batch.column(c)[at].as_py() for c in _UNIT]

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: t[c].combine_chunks()
        matrix = lambda c: column(c).flatten().to_numpy().reshape(t.num_rows, -1)
        unit = np.stack([column(c).to_numpy() for c in _UNIT])
        edge = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(0)) + 1
        values, offsets = column("shingles").flatten().to_numpy(), column("shingles").offsets.to_numpy()
        offsets = offsets - offsets[0]
        ids, a, b, group, tree, role = column("rep").to_numpy(), matrix("a"), matrix("b"), column("i").to_numpy(), column("tree").to_numpy(), column("role").to_numpy()
        u, v = [], []
        for lo, hi in zip([0, *edge], [*edge, t.num_rows], strict=True):
            if hi - lo < 2:
                continue
            xs, able = np.arange(hi - lo), None
            if unit[2, lo] >= 0:
                r, k, i = role[lo:hi], tree[lo:hi], ids[lo:hi]
                xs = np.flatnonzero(r & 1)
                able = {x: ((r & 2) > 0) & (k != k[x]) & (((r & 4) == 0) | (i > i[x])) for x in xs}
            sets = [values[offsets[k] : offsets[k + 1]] for k in range(lo, hi)]
            for x, y in _unit_links(sets, a[lo:hi], b[lo:hi], int(group[lo]), xs, able, percent):
                u.append(ids[lo + x])
                v.append(ids[lo + y])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = unit_of(batch, batch.num_rows - 1)
            whole = batch.num_rows
            while whole and unit_of(batch, whole - 1) == last:
                whole -= 1
            if whole:
                yield flush([*held, batch.slice(0, whole)])
                held = []
            elif held and unit_of(held[-1], 0) != last:
                yield flush(held)
                held = []
            held.append(batch.slice(whole))
        if held:
            yield flush(held)

    return run


def _compared(rows: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (u, v) of units: rows (rep, g, i, block, rest, tree, role), about n of them, with their sets."""
    rows = rows.join(sets, "rep").repartition("g", "block", "rest").sortWithinPartitions("g", "block", "rest", "rep")
    return materialize(rows.select("rep", "g", "i", "block", "rest", "tree", "role", "a", "b", "shingles").mapInArrow(_verify(percent), "u long, v long"), n, SETS)


def _members(reps: DataFrame, tuples: int) -> DataFrame:
    """(rep, n_shingles, i, g): the groups g, of tuple i of the first collection, in which a representative
    shares a table with another. tuples: a bound of the number of tuples of the first collection."""
    first = reps.select("rep", F.posexplode("a").alias("i", "tuple")).select("rep", "i", F.xxhash64("i", "tuple").alias("g"))
    shared = first.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    met = first.join(shared, "g", "left_semi")
    # keys of the tables, for these only: tuple i of the first collection with tuple j of the second
    table = materialize(met.join(reps.select("rep", "n_shingles", "b"), "rep").select("rep", "n_shingles", "i", "g", F.posexplode("b").alias("j", "other")).select("rep", "n_shingles", "i", "g", F.xxhash64("g", "j", "other").alias("t")), tuples)
    full = table.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t")
    return materialize(table.join(full, "t", "left_semi").select("rep", "n_shingles", "i", "g").distinct(), tuples)


def _units(member: DataFrame) -> DataFrame:
    """(g, i, blocks, hub0, ...): groups of the same members are one, the first, which keeps the pairs that
    no earlier group has. A hub is the member of least seeded hash."""
    hubs = [f"hub{s}" for s in range(HUBS)]
    least = [F.min(F.xxhash64(F.lit(s), "rep")).alias(h) for s, h in enumerate(hubs)]
    groups = member.groupBy("g").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("h2"), *least)
    groups = groups.groupBy("n", "h1", "h2").agg(F.min(F.struct("i", "g", "total", *hubs)).alias("x")).select("n", "x.*")
    return groups.select("g", "i", _blocks("n", "total").alias("blocks"), *hubs)


def _blocks(n: str, shingles: str) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(shingles) / BLOCK_SHINGLES))


def _each_of(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def _first_pass(dealt: DataFrame) -> DataFrame:
    """Each member in its block, and the hubs of a cut group in all of its blocks."""
    hub = F.lit(False)
    for s in range(HUBS):
        hub = hub | (F.xxhash64(F.lit(s), F.col("rep")) == F.col(f"hub{s}"))
    every = dealt.where((F.col("blocks") > 1) & hub).withColumn("block", _each_of(F.col("blocks")))
    rows = dealt.where((F.col("blocks") == 1) | ~hub).unionAll(every)
    return rows.select("rep", "g", "i", "block", F.lit(-1).cast("long").alias("rest"), F.lit(0).cast("long").alias("tree"), F.lit(0).alias("role"))


def _second_pass(cut: DataFrame, found: DataFrame) -> DataFrame:
    """Of groups cut into blocks the members that the first pass left outside the group's largest tree, each
    with all members, where not of its own tree. Where the first pass joined all, no row."""
    trees = connected_components(found).select(F.col("node").alias("rep"), F.col("component").alias("tree"))
    rows = cut.join(trees, "rep", "left").withColumn("tree", F.coalesce("tree", "rep"))
    sizes = rows.groupBy("g", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    main = sizes.groupBy("g").agg(F.max(F.struct("n", "total", "tree")).alias("main"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    main = main.select("g", F.col("main.tree").alias("main"), (F.col("n") - F.col("main.n")).alias("left"), (F.col("total") - F.col("main.total")).alias("size"))
    main = main.where("left > 0").select("g", "main", _blocks("left", "size").alias("rests"))
    rows = rows.join(main, "g").withColumn("over", F.col("tree") != F.col("main"))
    y = rows.withColumn("rest", _each_of(F.col("rests"))).withColumn("role", F.when(F.col("over"), 6).otherwise(2))
    x = rows.where("over").withColumn("block", _each_of(F.col("blocks"))).withColumn("rest", F.pmod(F.xxhash64(F.lit(-1), "rep"), F.col("rests"))).withColumn("role", F.lit(1))
    names = ["rep", "g", "i", "block", "rest", "tree", "role"]
    return y.select(names).unionAll(x.select(names))


def links(docs: DataFrame, reps: DataFrame, key: str, text: str, k: int, percent: int, half: int, side: int, repeated: bool, n: int) -> DataFrame:
    """A spanning forest (u, v) of the links between representatives (rep, n_shingles, a, b) of different sets."""
    member = _members(reps, n * side)
    dealt = member.join(_units(member), ["g", "i"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    active = member.select(F.col("rep").alias("__id")).distinct()
    wanted = F.broadcast(active) if active.count() <= BROADCAST_IDS else active
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("__text")).join(wanted, F.col("rep") == F.col("__id"), "left_semi")
    added = T.StructType([T.StructField("a", _LONGS), T.StructField("b", _LONGS), T.StructField("shingles", _LONGS)])
    sets = materialize(map_texts(texts.distinct() if repeated else texts, "__text", ["rep"], added, _kernel(k, half, side, True)), n, TEXTS)
    members = member.count()
    found = _compared(_first_pass(dealt), sets, percent, members)
    cut = dealt.where("blocks > 1")
    if cut.isEmpty():
        return found
    rest = materialize(_second_pass(cut, found), members)
    again = rest.count()
    return found.unionAll(_compared(rest, sets, percent, again)) if again else found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, half: int = HALF, side: int | None = None) -> DataFrame:
    """One row a row of docs: its key, n_shingles, component_id and kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of their distinct k-word
    shingles of lower-cased (A-Z) words; a text of fewer words is one shingle. component_id is the
    smallest key reachable over links. kept marks the document that has this key. Null, empty and
    wordless texts have no shingles and no links. Rows of one key are one document, linked by each
    of their texts. A null key is never linked: its component is null and it is kept. Other columns
    are ignored. Keys are integers. docs is counted and read twice, so write it first if it is costly to make.
    ``side`` follows from ``percent`` unless given.
    """
    side = side or sides(percent, half)
    added = T.StructType([T.StructField(c, T.LongType()) for c in ("n_shingles", "one", "two")] + [T.StructField(c, _LONGS) for c in ("a", "b")])
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("__text"))
    n = docs.count()
    signed = materialize(map_texts(source, "__text", ["id"], added, _kernel(k, half, side, False)), n, TEXTS)
    able = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    ids = signed.where(able).select("id", "one", "two")
    copies = materialize(ids.groupBy("one", "two").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), n)
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    classed = signed.join(copies, ["one", "two"], "left")
    columns = [F.col("id").alias("rep"), "n_shingles", "a", "b"]
    reps = classed.where(able & F.col("rep").isNull()).select(columns).unionAll(classed.where(able & (F.col("rep") == F.col("id"))).dropDuplicates(["one", "two"]).select(columns))
    # rows of one key link the classes of their texts
    repeated = materialize(ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__id")), n)
    again = not repeated.isEmpty()
    found = links(docs, reps, key, text, k, percent, half, side, again, n)
    if again:
        found = found.unionAll(classed.where(able & F.col("rep").isNotNull()).join(repeated, F.col("id") == F.col("__id"), "left_semi").select(F.col("id").alias("u"), F.col("rep").alias("v")))
    groups = connected_components(found).select(F.col("node").alias("__node"), "component")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    first = F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))
    out = classed.select("id", "n_shingles", first.alias("first")).join(groups, F.col("first") == F.col("__node"), "left")
    kind = docs.schema[key].dataType
    out = out.coalesce(max(1, -(-n // TEXTS)))
    out = out.select(F.col("id").cast(kind).alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "first")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs less the rows whose near-duplicate group has a smaller key. Columns are those of docs."""
    gone = materialize(near_duplicates(docs, key, text, k, percent).where(~F.col("kept")).select(F.col(key).alias("__gone")).distinct())
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, k=3, percent=85)


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.c + y.c - i)
), b AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON r.c = b.u
)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
