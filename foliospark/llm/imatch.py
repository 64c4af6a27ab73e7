"""Document fingerprints by I-Match, with DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band of inverse document
frequency. Of a document the distinct terms in the lexicon are sorted and hashed, once over the
whole lexicon and once over each of several randomised subsets of it. The subsets keep terms at
falling rates, so that documents of any length have subsets that catch one or two of their terms.

Documents are first counted by place, the low BITS bits of a term's 64-bit hash. A place has at
least the count of each of its terms, so only terms in places with enough are counted exactly, by
their hashes. A document's mean number of distinct terms over LEAST bounds the terms in the band at
any corpus size. Three bitmaps of places let the band's terms through, and in 10,000 of the others about
one where a tenth of the places are taken; those of the corpus are listed beside and are left out. So membership
is exact for every term of the corpus, with a plan of fixed size. A word that an edit cuts in two and that
no document has is no term of the corpus; it passes as rarely.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import materialize

#: Bounds of a term's share of documents, in 1 / 10000.
LEAST, MOST = 20, 2000
BITS, PLACES = 19, 3
#: Subsets of each rate 1/4, 1/8, ... 1/512. A rate has its own seeded hash of a term, and each of its
#: subsets WIDTH bits of that.
RATES, EACH, WIDTH = range(2, 10), 6, 10
#: Spark's hash of an array without elements is its seed.
_EMPTY = 42
_BLANK = r"[\x20\x09-\x0D]+"
_LEAST_KEY = -(2**63)


def words(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased words of a text; an empty word among them is nobody's."""
    return F.array_distinct(F.transform(F.split(F.lower(text), _BLANK, -1), lambda w: F.xxhash64(w)))


def _place(h: Column, which: int = 0) -> Column:
    """One of PLACES disjoint ranges of BITS bits of a hash."""
    return F.shiftright(h, 20 * which).bitwiseAND(F.lit((1 << BITS) - 1))


def _constant(values: np.ndarray) -> Column:
    """An array of longs as one constant, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def _bitmap(places: np.ndarray) -> Column:
    """A constant array of 2 ** BITS / 64 longs with the bits of these places."""
    bitmap = np.zeros(1 << (BITS - 6), np.int64)
    np.bitwise_or.at(bitmap, places >> 6, np.int64(1) << (places & 63))
    return _constant(bitmap)


def _in_bitmap(h: Column, bitmap: Column, which: int = 0) -> Column:
    p = _place(h, which)
    cell = F.get(bitmap, F.shiftright(p, 6).cast("int"))
    return F.call_function("shiftrightunsigned", cell, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


class Lexicon:
    """The terms of the band as a constant of fixed size: bitmaps of their places, and the few terms of the
    corpus outside the band that all bitmaps let through."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.outside = hashes, np.empty(0, np.int64)
        self.bitmaps = [_bitmap((hashes >> (20 * k)) & ((1 << BITS) - 1)) for k in range(PLACES)]

    def near(self, h: Column) -> Column:
        out = F.lit(True)
        for k, bitmap in enumerate(self.bitmaps):
            out = out & _in_bitmap(h, bitmap, k)
        return out

    def holds(self, h: Column) -> Column:
        return self.near(h) & ~F.array_contains(_constant(self.outside), h) if len(self.outside) else self.near(h)


def lexicon(docs: DataFrame, text: str = "text", least: int = LEAST, most: int = MOST) -> Lexicon:
    """The lexicon of the terms in the band, by exact counts over all documents; a null text counts
    as one without terms."""
    total, empty = docs.count(), F.xxhash64(F.lit(""))
    # multiplied here: as integer columns the product overflows over a million documents
    low, high = (F.lit(total * bound).cast("long") for bound in (least, most))
    found = F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda h: h != empty)
    places = F.array_distinct(F.transform(found, lambda h: _place(h).cast("int")))
    n = docs.select(F.explode(places).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    often = n.where(F.col("n") * 10000 >= low).select("place").toArrow()["place"].to_numpy().astype(np.int64)
    some = _bitmap(often)
    terms = docs.select(F.explode(F.filter(found, lambda h: _in_bitmap(h, some))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    terms = materialize(terms)
    inside = (F.col("n") * 10000 >= low) & (F.col("n") * 10000 <= high)
    out = Lexicon(np.sort(terms.where(inside).select("h").toArrow()["h"].to_numpy().astype(np.int64)))
    # every term that passes the first bitmap is among the terms counted
    out.outside = np.sort(terms.where(~inside & out.near(F.col("h"))).select("h").toArrow()["h"].to_numpy().astype(np.int64))
    return out


def terms(text: Column, band: Lexicon) -> Column:
    """Sorted hashes of the terms of a text in the lexicon; a text without any is its own only term."""
    found = F.array_sort(F.filter(words(text), band.holds))
    # bound to a variable, so that the text is gone through once
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.xxhash64(text, F.lit("whole")))))[0]


def slots(found: Column) -> Column:
    """Hash of all sorted terms, then of those in each subset: terms in their order, under the rate's hash."""
    parts = [F.array(F.hash(found))]
    for rate in RATES:
        seeded = F.transform(found, lambda h: F.xxhash64(h, F.lit(rate)))  # noqa: B023
        masks = [F.lit(((1 << rate) - 1) << (WIDTH * j)) for j in range(EACH)]
        # bound to a variable, so that a rate is hashed once
        parts.append(F.transform(F.array(seeded), lambda s: F.array(*[F.hash(F.filter(s, lambda x: x.bitwiseAND(m) == 0)) for m in masks]))[0])  # noqa: B023
    return F.concat(*parts)


def fingerprint(rows: DataFrame, text: str, band: Lexicon, name: str) -> DataFrame:
    """rows with the array of slot hashes of a text column (null as empty) as column ``name``."""
    found = terms(F.coalesce(F.col(text), F.lit("")), band)
    return rows.withColumn("__terms", found).withColumn(name, slots(F.col("__terms"))).drop("__terms")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots among those that are not empty in both."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == _EMPTY) & (y == _EMPTY), F.lit(None).cast("int")).when(x == y, F.lit(1)).otherwise(F.lit(0)))
    counted = F.filter(pairs, lambda x: x.isNotNull())
    return F.aggregate(counted, F.lit(0), lambda s, x: s + x) / F.greatest(F.size(counted), F.lit(1))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.when(x == _EMPTY, F.lit("")).otherwise(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))), ":")


def followers(docs: DataFrame, key: str, size: Column) -> DataFrame:
    """(key, next_key, most): each key's successor in descending order, the last one's the first.

    most is the largest ``size`` of the key's rows. Keys are range-partitioned; a window in each
    range finds successors, and one row a range, so never more than ranges, joins their ends.
    """
    ids = docs.groupBy(key).agg(F.max(size).alias("most"))
    ranged = materialize(ids.repartitionByRange(F.col(key).desc()).withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.max(key).alias("head"))
    ends = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.max("head").over(Window.partitionBy())).alias("end"))
    inner = F.lead(key).over(Window.partitionBy("part").orderBy(F.col(key).desc()))
    return ranged.withColumn("inner", inner).join(ends, "part").select(key, F.coalesce("inner", "end").alias("next_key"), "most")


def query(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness.

    The edited text is the text with its last half (rounded down) replaced by as much of the
    beginning of the next document, by descending id. Null texts count as empty. A null id comes
    last. Rows of one id are all followed by the next id, whose shortest text, and of these the
    least, stands for it; a table of one id follows itself. Other columns are never read.
    """
    band = lexicon(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_KEY)).alias("k"), F.coalesce("text", F.lit("")).alias("original"))
    pairs = materialize(followers(rows, "k", F.length("original")))
    size = F.length("original")
    # fingerprints come before the only shuffle of texts; what follows moves them with the beginnings
    source = fingerprint(rows, "original", band, "own")
    begins = source.join(pairs.select(F.col("next_key").alias("k"), F.col("k").alias("of"), "most"), "k")
    begins = begins.select("of", size.alias("size"), F.left("original", F.floor(F.col("most") / 2).cast("int")).alias("head"), F.col("own").alias("next"))
    least = F.row_number().over(Window.partitionBy("of").orderBy("size", "head", "next"))
    begins = begins.withColumn("n", least).where("n = 1").select(F.col("of").alias("k"), "head", "next")
    half = F.floor(size / 2).cast("int")
    both = source.join(begins, "k").withColumn("edited", F.concat(F.left("original", size - half), F.left("head", half)))
    out = fingerprint(both, "edited", band, "other")
    return out.select(
        F.nullif("k", F.lit(_LEAST_KEY)).alias("doc_id"),
        size.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
