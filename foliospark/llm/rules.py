"""Quality rules as a bitmask ledger.

Every rule is evaluated once. Its failure sets one bit of ``fail_bits``; the
measurements stay beside it. A policy is a mask over those bits with a version,
so changing a policy or asking what one rule costs reads the ledger, not the texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import WORD, map_texts, materialize

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Name and failing condition of each rule; a rule's place is its bit. Integer arithmetic only.
RULES = [
    ("too_short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
]
BASE_MASK = 0b00011
#: Policy masks by version.
POLICIES = {1: 0b00011, 2: 0b11111}
POLICY = 2


def _measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    points = np.frombuffer(text, np.uint8)
    n_points = int(np.count_nonzero((points & 0xC0) != 0x80))
    spaces = len(text) - len(text.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    repeat = 0
    if n >= 3:
        index: dict[bytes, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        # pairs get dense numbers first, so that any text's windows fit 64 bits
        pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
        _, place, count = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        again = count[place] >= 2
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        repeat = int(covered.sum())
    return n, n_points - spaces, symbols, len(lines) - len(set(lines)), repeat, len(lines)


def _kernel(texts: list[bytes]) -> list:
    return list(zip(*map(_measure, texts), strict=True)) or [[] for _ in MEASURES]


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, the measurements and ``fail_bits`` of every row.

    A null text counts as empty: every measurement is 0 and only ``too_short`` fails.
    Repeated rows are measured one by one. Carried columns named like a measurement give way.
    """
    added = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES])
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() != "fail_bits"]
    out = map_texts(docs, text, carry, added, _kernel)
    bits = sum((F.when(F.expr(rule), 1 << k).otherwise(0) for k, (_, rule) in enumerate(RULES)), F.lit(0))
    return out.withColumn("fail_bits", bits.cast("long"))


def verdict(mask: int) -> F.Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0


def apply_policy(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under one policy version."""
    return rows.withColumn("base_failed", ~verdict(BASE_MASK)).withColumn("kept", verdict(BASE_MASK | POLICIES[version]))


def ablations(rows: DataFrame, version: int = POLICY) -> DataFrame:
    """One row a rule: rows failing it, rows failing it alone, and rows kept with the rule struck from the policy.

    One pass and one partial aggregate; an empty ledger gives zeros.
    """
    mask = POLICIES[version]
    sums = [F.coalesce(F.sum(verdict(mask).cast("long")), F.lit(0)).alias("kept")]
    for k in range(len(RULES)):
        bit = F.lit(1 << k)
        sums.append(F.coalesce(F.sum((F.col("fail_bits").bitwiseAND(bit) != 0).cast("long")), F.lit(0)).alias(f"f{k}"))
        sums.append(F.coalesce(F.sum(verdict(mask & ~(1 << k)).cast("long")), F.lit(0)).alias(f"w{k}"))
    table = [F.struct(F.lit(name).alias("rule"), F.lit(k).alias("bit"), F.col(f"f{k}").alias("failed"), (F.col(f"w{k}") - F.col("kept")).alias("failed_alone"), F.col(f"w{k}").alias("kept_without")) for k, (name, _) in enumerate(RULES)]
    return rows.agg(*sums).select(F.inline(F.array(*table)))


def query(docs: DataFrame) -> DataFrame:
    rows = apply_policy(ledger(docs, carry=["doc_id"]))
    return rows.select("doc_id", *MEASURES[:5], "base_failed", "kept", "n_lines", "fail_bits")


_BITS = " + ".join(f"CASE WHEN {rule} THEN {1 << k} ELSE 0 END" for k, (_, rule) in enumerate(RULES))
ORACLE = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM documents
), tri AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) >= 2
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       ({_BITS}) = 0 AS kept, n_lines, ({_BITS})::BIGINT AS fail_bits
FROM m"""


def ablation_query(docs: DataFrame) -> DataFrame:
    """Ablations of the production policy, from a ledger that is written once and read again."""
    return ablations(materialize(ledger(docs, carry=["doc_id"])))


_MASK = POLICIES[POLICY]
_NAMES = ", ".join(f"('{name}', {k})" for k, (name, _) in enumerate(RULES))
ABLATION_ORACLE = f"""
WITH l AS ({ORACLE}), r(rule, bit) AS (VALUES {_NAMES})
SELECT rule, bit, count(*) FILTER (WHERE fail_bits >> bit & 1 = 1) AS failed,
       count(*) FILTER (WHERE fail_bits & {_MASK} & ~(1 << bit) = 0) - count(*) FILTER (WHERE fail_bits & {_MASK} = 0) AS failed_alone,
       count(*) FILTER (WHERE fail_bits & {_MASK} & ~(1 << bit) = 0) AS kept_without
FROM r LEFT JOIN l ON true GROUP BY rule, bit"""
