"""Scalar functions of the engine as Column expressions: geometry, labels, checksums, image sizes.

All but the Adler-32 checksum stay in the JVM. Boxes are structs or sets of four columns llx, lly, urx, ury.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators import marks as m


def overlap_len(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def box_area(b: Column) -> Column:
    return F.abs((b["urx"] - b["llx"]) * (b["ury"] - b["lly"]))


def box(llx: Column, lly: Column, urx: Column, ury: Column) -> Column:
    """A box of two corners in any order."""
    return F.struct(F.least(llx, urx).alias("llx"), F.least(lly, ury).alias("lly"), F.greatest(llx, urx).alias("urx"), F.greatest(lly, ury).alias("ury"))


def inter_area(a: Column, b: Column) -> Column:
    return overlap_len(a["llx"], a["urx"], b["llx"], b["urx"]) * overlap_len(a["lly"], a["ury"], b["lly"], b["ury"])


def overlaps(a: Column, b: Column) -> Column:
    return inter_area(a, b) / F.greatest(F.least(box_area(a), box_area(b)), F.lit(1.0)) > 0.4


def clamp_box(b: Column, page: Column, least_width: float) -> Column:
    """b cut to the page; null if too little is left."""
    cut = F.struct(F.greatest(b["llx"], page["llx"]).alias("llx"), F.greatest(b["lly"], page["lly"]).alias("lly"), F.least(b["urx"], page["urx"]).alias("urx"), F.least(b["ury"], page["ury"]).alias("ury"))
    return F.when((cut["urx"] - cut["llx"] >= least_width) & (cut["ury"] - cut["lly"] >= 6.0), cut)


def holds(page: Column, b: Column) -> Column:
    x, y = (b["llx"] + b["urx"]) / 2, (b["lly"] + b["ury"]) / 2
    return x.between(page["llx"] - 4, page["urx"] + 4) & y.between(page["lly"] - 4, page["ury"] + 4)


def is_page_frame(b: Column, page: Column) -> Column:
    return (F.abs(b["llx"] - page["llx"]) < 8) & (F.abs(b["lly"] - page["lly"]) < 8) & (F.abs(page["urx"] - b["urx"]) < 8) & (F.abs(page["ury"] - b["ury"]) < 8)


def classify_box(b: Column, page: Column) -> Column:
    """"checkbox", "text" or null."""
    w, h = b["urx"] - b["llx"], b["ury"] - b["lly"]
    out = F.when((w < 6) | (h < 6) | (w * h > box_area(page) * 0.45) | is_page_frame(b, page), F.lit(None).cast("string"))
    out = out.when((w <= 24) & (h <= 24) & (w / h).between(0.7, 1.45), F.lit("checkbox"))
    return out.when((w >= 36) & h.between(10, 220) & (w <= (page["urx"] - page["llx"]) * 0.95), F.lit("text"))


def underscore_box(x: Column, y: Column, w: Column, size: Column, up: Column) -> Column:
    h = F.least(F.greatest(size, F.lit(8.0)), F.lit(18.0))
    low, high = F.when(up >= 0, 0.25).otherwise(0.95), F.when(up >= 0, 0.95).otherwise(0.25)
    return F.struct(x.alias("llx"), (y - h * low).alias("lly"), (x + w).alias("urx"), (y + h * high).alias("ury"))


def fit_size(w: Column, h: Column, edge: int) -> Column:
    """The size within ``edge`` as a struct (w, h)."""
    longest = F.greatest(w, h)
    to = lambda x: F.when(longest <= edge, x).otherwise(F.greatest(F.lit(1), F.round(x * (F.lit(float(edge)) / longest)))).cast("long")
    return F.struct(to(w).alias("w"), to(h).alias("h"))


def is_underscores(t: Column) -> Column:
    return t.rlike(r"^\s*_{3,}\s*$")


def is_bad_label(t: Column) -> Column:
    return (F.trim(t) == "") | is_underscores(t)


def underscore_runs(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"(_+|[^_]+)"), 0)


def sanitize_label(t: Column) -> Column:
    """A label as a field name; null where it can't be one."""
    x = F.regexp_replace(t, r"(?U)^[-*•·\s]+", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+$", ""), r"[:.* \t]+$", ""), r"(?U)\s+$", "")
    words = F.size(F.regexp_extract_all(x, F.lit(r"(?U)(\S+)"), 1))
    clean = F.regexp_replace(F.regexp_replace(x, r"\p{Cc}", ""), r"\.", "_")
    clean = F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))
    return F.when(x.rlike(r"[\p{L}\p{N}]") & (words <= 8) & (F.length(x) <= 48) & (clean != ""), clean)


def _hundredths(c: Column) -> Column:
    kinds = [(" \t", m.EM_SPACE), (m.NARROW, m.EM_NARROW), (m.DASHES, m.EM_DASH), (m.WIDE, m.EM_WIDE)]
    out = None
    for chars, value in kinds:
        test, n = F.lit(chars).contains(c), round(value * 100)
        out = F.when(test, n) if out is None else out.when(test, n)
    return out.when(c.rlike(r"\p{Lu}"), round(m.EM_UPPER * 100)).when(c.rlike("[0-9]"), round(m.EM_DIGIT * 100)).otherwise(round(m.EM_OTHER * 100))


def width_hundredths(t: Column) -> Column:
    """The width of a text in hundredths of an em."""
    return F.aggregate(F.split(t, ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(_hundredths(c)))


@F.pandas_udf(T.LongType())
def _adler32(b: pd.Series) -> pd.Series:
    import zlib

    return pd.Series([None if x is None else zlib.adler32(x) for x in b], dtype="Int64")


def adler32(b: Column) -> Column:
    """The Adler-32 checksum of a binary column; null of null. One pass a value, in Arrow batches: no built-in
    function computes it, and a fold over bytes takes time in the square of a value's length."""
    return _adler32(b)


def quant_scale(base: Column, quality: Column) -> Column:
    q = F.greatest(F.least(quality, F.lit(100)), F.lit(1))
    scale = F.when(q < 50, F.expr("5000") / q).otherwise(200 - 2 * q)
    return F.greatest(F.least(F.floor((base * F.floor(scale) + 50) / 100), F.lit(255)), F.lit(1)).cast("long")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(r * 77 + g * 150 + b * 29, 8)


def pdf_text(b: Column) -> Column:
    """The text of a PDF string's bytes."""
    return F.when(F.hex(F.substring(b, 1, 2)) == "FEFF", F.decode(F.substring(b, F.lit(3), F.octet_length(b)), "UTF-16BE")).otherwise(F.decode(b, "ISO-8859-1"))


def pdf_bytes(t: Column) -> Column:
    return F.when(t.rlike(r"^[\x00-\xFF]*$"), F.encode(t, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE")))
