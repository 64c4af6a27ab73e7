"""The label searches over tables: for each slot the label of least distance, of any number of files.

Runs and slots meet in an equi-join on their file, page and a band of BAND points of height. Each side has an
interval of heights such that only intervals that meet can match; a pair meets in the band where the later of
both intervals begins, so once. No list of candidates is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import native as n

BAND = 80.0
KEYS = ["file", "page"]
_OVER = "greatest(0D, least(x + w, urx) - greatest(x, llx))"
#: By search: distance, condition, and the heights of a run and of a slot that can match.
SEARCHES = {
    "left": ("llx - (x + w)", "llx - (x + w) BETWEEN -4 AND 80 AND y - lly BETWEEN -4 AND size * 0.9 + 2", ("y - size * 0.9 - 2", "y + 4"), ("lly", "lly")),
    "beside": ("x - urx", "x - urx BETWEEN -6 AND 90 AND {level}", ("y + size * 0.3 - size * 0.85", "y + size * 0.3 + size * 0.85"), ("{middle} - {high}", "{middle} + {high}")),
    "beside_left": ("llx - (x + w)", "llx - (x + w) BETWEEN -6 AND 90 AND {level}", ("y + size * 0.3 - size * 0.85", "y + size * 0.3 + size * 0.85"), ("{middle} - {high}", "{middle} + {high}")),
    "above": ("y - ury", f"y - ury BETWEEN -2 AND 36 AND ({_OVER} >= 8 OR abs(x - llx) < 48)", ("y - 36", "y + 2"), ("ury", "ury")),
    "above_line": ("y - lly", f"y - lly BETWEEN 1 AND 32 AND ({_OVER} >= 10 OR abs(x - llx) <= 40)", ("y - 32", "y - 1"), ("lly", "lly")),
}
_PARTS = {"level": "abs(y + size * 0.3 - (lly + ury) * 0.5) <= greatest(size * 0.85, (ury - lly) * 0.7)", "middle": "(lly + ury) * 0.5", "high": "(ury - lly) * 0.7"}


def _banded(rows: DataFrame, low: str, high: str) -> DataFrame:
    first, last = (F.floor(F.expr(x.format(**_PARTS)) / BAND) for x in (low, high))
    return rows.withColumn("__first", first).withColumn("__band", F.explode(F.sequence(first, last)))


def _met(slots: DataFrame, runs: DataFrame, run: tuple[str, str], slot: tuple[str, str]) -> DataFrame:
    s, r = _banded(slots, *slot).withColumnRenamed("__first", "__from"), _banded(runs, *run)
    return s.join(r, [*KEYS, "__band"]).where(F.col("__band") == F.greatest("__first", "__from"))


def labels(runs: DataFrame) -> DataFrame:
    """The runs (file, page, seq, text, x, y, w, size) that can be labels."""
    return runs.where(~n.is_bad_label(F.col("text")))


def nearest_label(slots: DataFrame, runs: DataFrame, search: str, key: str = "slot") -> DataFrame:
    """(key, label, distance) of slots (key, file, page, llx, lly, urx, ury): of runs that match the search, the
    one of least distance, the first of the page on ties. A slot without any has no row."""
    distance, near, run, slot = SEARCHES[search]
    pairs = _met(slots, labels(runs), run, slot).where(near.format(**_PARTS)).withColumn("distance", F.expr(distance))
    return pairs.groupBy(key).agg(F.min_by("text", F.struct("distance", "seq")).alias("label"), F.min("distance").alias("distance"))


def _inside() -> Column:
    return F.expr("x + w * 0.5 > llx + 1.5 AND x + w * 0.5 < urx - 1.5 AND y + size * 0.35 > lly + 1.5 AND y + size * 0.35 < ury - 1.5")


def without_text(slots: DataFrame, runs: DataFrame, key: str = "slot") -> DataFrame:
    """The slots in which no label stands."""
    held = _met(slots, labels(runs), ("y + size * 0.35",) * 2, ("lly", "ury")).where(_inside()).select(key).distinct()
    return slots.join(held, key, "left_anti")
