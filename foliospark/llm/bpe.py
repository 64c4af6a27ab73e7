"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut by the tokenizer's pattern. The pieces a worker hasn't met yet become
token-position rows; a recursive query joins neighbours with the merge table and contracts
each piece's leftmost pair of least rank until no piece has a pair. Pieces of any length go
through such a query. Ordered aggregation gives the ids of a piece, and the bytes that these ids
stand for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.llm.common import map_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of pieces encoded in one query.
QUERY_BYTES = 250_000
#: A worker remembers the pieces of its last texts in two halves of this many; the older half is
#: forgotten when the newer is full, except for what has been met again meanwhile.
HALF_CACHE = 300_000
#: Pieces of more bytes than this go to a recursion that keeps one row a place and changes it in place;
#: the plain one keeps the rows of all steps, which for a piece of n bytes are n * n. The keyed one reads all
#: rows of a query at each step, so that it is slow on many short pieces. Both give the same tokens.
LONG_PIECE = 400
LONG_BYTES = 20_000
_PLACES = 30

#: Rows (step, w, p, t, x): token t of piece w at place p, and the place of the next token or -1.
#: A piece without a pair left passes once more, as step -1.
_ENCODE = f"""
WITH RECURSIVE seq(step, w, p, t, x) AS (
  SELECT 0, w, p, t, x FROM start
  UNION ALL
  (
    WITH pair AS (
      SELECT a.w, (m << {_PLACES}) | a.p AS k, b.p AS gone, b.x AS after
      FROM seq a JOIN seq b ON a.x = b.p JOIN merges ON l = a.t AND r = b.t WHERE a.step >= 0 AND b.step >= 0
    ), best AS (
      SELECT w, min(k) AS k, arg_min(gone, k) AS gone, arg_min(after, k) AS after FROM pair GROUP BY w
    ), kept AS (
      SELECT s.*, k, after, s.p = k & {(1 << _PLACES) - 1} AS here FROM seq s LEFT JOIN best ON s.w = best.w WHERE s.step >= 0 AND (k IS NULL OR s.p <> gone)
    )
    SELECT CASE WHEN k IS NULL THEN -1 ELSE step + 1 END, w, p, CASE WHEN here THEN k >> {_PLACES} ELSE t END, CASE WHEN here THEN after ELSE x END FROM kept
  )
)
SELECT w, p, t FROM seq WHERE step < 0"""

#: Rows (w, p) with token t, next place x, and k, the token of the pair that begins here. One step contracts
#: all pairs of least rank in a piece, those that overlap from the left, unless the new token has a pair of
#: lesser rank than its own (early): then only the leftmost, for that pair comes first.
_ENCODE_LONG = """
WITH RECURSIVE seq(w, p, t, x, k, early) USING KEY (w, p) AS (
  SELECT a.w, a.p, a.t, a.x, m, early FROM start a LEFT JOIN start b ON a.x = b.p LEFT JOIN merges ON l = a.t AND r = b.t
  UNION
  (
    WITH least AS (SELECT w, min(k) AS k FROM recurring.seq GROUP BY w HAVING min(k) IS NOT NULL),
    hit AS (
      SELECT s.w, s.p, s.x, s.k, s.early, CASE WHEN lag(s.x) OVER (ORDER BY s.p) IS DISTINCT FROM s.p THEN s.p END AS head
      FROM recurring.seq s JOIN least ON s.w = least.w AND s.k = least.k
    ), run AS (
      SELECT *, last_value(head IGNORE NULLS) OVER (ORDER BY p) AS h FROM hit
    ), chosen AS (
      SELECT w, p, x AS gone, k FROM run
      QUALIFY row_number() OVER (PARTITION BY h ORDER BY p) % 2 = 1 AND (NOT early OR row_number() OVER (PARTITION BY w ORDER BY p) = 1)
    ), merged AS (
      SELECT chosen.w, chosen.p, chosen.k AS t, g.x FROM chosen JOIN recurring.seq g ON g.p = chosen.gone
    ), before AS (
      SELECT s.w, s.p, s.t, s.x FROM recurring.seq s SEMI JOIN chosen ON s.x = chosen.p
      WHERE s.t >= 0 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.gone = s.p OR c.p = s.p)
    ), touched AS (
      SELECT * FROM merged UNION ALL SELECT * FROM before
    ), ahead AS (
      SELECT touched.*, coalesce(n.t, s.t) AS after FROM touched LEFT JOIN merged n ON n.p = touched.x LEFT JOIN recurring.seq s ON s.p = touched.x
    )
    SELECT w, p, ahead.t, x, m, early FROM ahead LEFT JOIN merges ON l = ahead.t AND r = after
    UNION ALL SELECT w, gone, -1, -1, NULL, NULL FROM chosen
  )
)
SELECT w, p, t FROM seq WHERE t >= 0"""

_DECODE = """
SELECT w, count(*) AS n, string_agg(t::VARCHAR, ' ' ORDER BY p) AS ids, string_agg(h, '' ORDER BY p) AS bytes
FROM tokens JOIN vocabulary ON id = t GROUP BY w"""


class Codec:
    """A vocabulary of ranks in one DuckDB connection, with what it has encoded so far."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        l, r, m = (pa.array(x, pa.int64()) for x in zip(*pairs, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self._fill("merges", pa.table({"l": l, "r": r, "m": m}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE merges AS SELECT l, r, m, m IN (SELECT l FROM merges WHERE m < l UNION SELECT r FROM merges WHERE m < r) AS early FROM merges")
        self._fill("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int64()), "h": [t.hex() for t in self.ranks]}))

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contract(self, pieces: list[bytes], query: str = _ENCODE) -> pa.Table:
        """Token-position rows (w, p, t) of the pieces at the fixpoint."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(x) for x in pieces])
        w = np.repeat(np.arange(len(pieces)), lengths)
        p = np.arange(len(flat))
        single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lengths) - 1] = True
        self._fill("start", pa.table({"w": w, "p": p, "t": single[flat], "x": np.where(last, -1, p + 1)}))
        return self.db.sql(query).to_arrow_table()

    def _remember(self, pieces: Iterable[str]) -> None:
        fresh = [(x, x.encode()) for x in pieces]
        fresh.sort(key=lambda x: len(x[1]))
        at = 0
        while at < len(fresh):
            long = len(fresh[at][1]) > LONG_PIECE
            to, size = at, 0
            while to < len(fresh) and (len(fresh[to][1]) > LONG_PIECE) == long and (size == 0 or size + len(fresh[to][1]) <= (LONG_BYTES if long else QUERY_BYTES)):
                size += len(fresh[to][1])
                to += 1
            rows = self._contract([b for _, b in fresh[at:to]], _ENCODE_LONG if long else _ENCODE)
            for w, n, ids, decoded in self._aggregate(rows):
                self.known[fresh[at + w][0]] = (n, ids, decoded)
            at = to

    def _aggregate(self, rows: pa.Table) -> list[tuple[int, int, str, bytes]]:
        self.db.register("tokens", rows)
        out = [(w, n, ids, bytes.fromhex(h)) for w, n, ids, h in self.db.execute(_DECODE).fetchall()]
        self.db.unregister("tokens")
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its pieces as (number of ids, ids as text, decoded bytes)."""
        cut = [self.pattern.findall(x) for x in texts]
        if len(self.known) > HALF_CACHE:
            self.known, self.older = {}, self.known
        known, older, fresh = self.known, self.older, []
        for p in set().union(*cut).difference(known):
            if p in older:
                known[p] = older[p]
            else:
                fresh.append(p)
        if fresh:
            self._remember(fresh)
        return [[known[p] for p in x] for x in cut]

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids. An id outside the vocabulary raises KeyError."""
        for x in ids:
            for t in x:
                self.tokens[t]
        w = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        p = np.concatenate([np.arange(len(x)) for x in ids]) if ids else np.empty(0, np.int64)
        rows = pa.table({"w": pa.array(w, pa.int64()), "p": pa.array(p, pa.int64()), "t": pa.array([t for x in ids for t in x], pa.int64())})
        found = {w: b for w, _, _, b in self._aggregate(rows)} if len(w) else {}
        return [found.get(k, b"") for k in range(len(ids))]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's codec of a vocabulary; a worker keeps it from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: list[str] | None = None, digest: bool = False) -> DataFrame:
    """Carried columns with ``n_tokens`` and ``ids``, without special tokens.

    With ``digest``, instead of ids, ``ids_sha256`` of the decimal ids joined by one space and
    ``decoded_sha256`` of the bytes decoded from them. Null and empty texts have no ids.
    ``path`` names a file that executors can open. Repeated rows are encoded alike.
    """
    names = ["ids_sha256", "decoded_sha256"]
    fields = [T.StructField(c, T.StringType()) for c in names] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType()))]

    def kernel(texts: list[bytes], own: Codec) -> list:
        rows = own.encode([x.decode("utf-8", "replace") for x in texts])
        n = [sum(x[0] for x in row) for row in rows]
        joined = [" ".join([x[1] for x in row]) for row in rows]
        if not digest:
            return [n, [[int(t) for t in x.split()] for x in joined]]
        return [n, [hashlib.sha256(x.encode()).hexdigest() for x in joined], [hashlib.sha256(b"".join([x[2] for x in row])).hexdigest() for row in rows]]

    added = T.StructType([T.StructField("n_tokens", T.LongType()), *fields])
    return map_texts(docs, text, docs.columns if carry is None else carry, added, kernel, lambda: codec(path, pattern))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the bytes of the array column ``ids`` as column ``text``; null ids give empty bytes."""
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != text], T.StructField(text, T.BinaryType())])
    rows = rows.select(*[f"`{f.name}`" for f in schema.fields[:-1]])

    def run(batches):
        for batch in batches:
            got = codec(path, pattern).decode([x or [] for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, carry=["doc_id"], digest=True)
