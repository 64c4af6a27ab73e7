"""Queries over files that are made from keys: slots of every kind, marks, boxes, images and odd files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.plans import files
from foliospark.plans.registry import query, table
from foliospark.sources import layouts
from foliospark.sources.pdf import read_files
from foliospark.sources.sinks import write_files
from foliospark.sources.storage import workspace, written
from foliospark.sources.synthetic import made


def _files(spark: SparkSession, d: str, name: str, columns: list[str], kernel: Callable[..., bytes]) -> DataFrame:
    return made(table(spark, d, name), columns, kernel)


def _key(name: str) -> F.Column:
    return F.col("path").cast("long").alias(name)


_AT = "(c_custkey % 40)::DOUBLE AS x, (c_custkey % 60)::DOUBLE AS y, c_custkey % 12 AS layout, least(greatest(8 + c_custkey % 12, 10), 16)::DOUBLE AS high FROM customer"
_SLOTS_OF = [
    (0, 1, "text", "Name", "140", "696.5", "360", "696.5 + high"),
    (2, 1, "text", "Phone", "130", "696.5", "360", "708.5"),
    (3, 1, "text", "City", "110", "696.5", "310", "708.5"),
    (4, 1, "text", "Office", "100", "600", "300", "640"),
    (4, 2, "text", "Text1", "100", "560", "300", "600"),
    (6, 1, "text", "Notes", "72", "640", "292", "700"),
    (8, 1, "text", "Notes", "72", "640", "292", "700"),
    (9, 1, "text", "First Name", "140", "696.5", "360", "708.5"),
    (10, 1, "checkbox", "Agree", "72", "640", "86", "654"),
    (11, 1, "text", "Text1", "72", "697", "96", "711.4"),
]


@query(f"WITH k AS (SELECT c_custkey, {_AT})\n" + "\nUNION ALL ".join(
    f"SELECT c_custkey, {no} AS field_no, '{kind}' AS kind, '{name}' AS name, round({a} + x, 3)::DOUBLE AS llx, round({b} - y, 3)::DOUBLE AS lly, round({c} + x, 3)::DOUBLE AS urx, round({e} - y, 3)::DOUBLE AS ury FROM k WHERE layout = {layout}"
    for layout, no, kind, name, a, b, c, e in _SLOTS_OF))
def form_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Slots of lines, merged and stressed lines, flat and plain rectangles, grids, framed pages, boxes that hold text,
    boxes on each other, squares and underscores, with their labels."""
    out = files.form_fields(_files(spark, d, "customer", ["c_custkey"], layouts.layout_file))
    return out.select(_key("c_custkey"), "field_no", "kind", "name", *[F.round(F.col("rect")[k], 3).alias(c) for k, c in enumerate(("llx", "lly", "urx", "ury"))])


@query("""SELECT c_custkey, n AS fields_added, n = 0 AS kept_original, CASE WHEN n = 0 THEN 'no empty slots found' ELSE 'fields: ' || n || '  text: ' || t || '  checkbox: ' || n - t END AS notes
FROM (SELECT c_custkey, CASE c_custkey % 12 WHEN 1 THEN 0 WHEN 5 THEN 0 WHEN 7 THEN 0 WHEN 4 THEN 2 ELSE 1 END::BIGINT AS n, CASE c_custkey % 12 WHEN 1 THEN 0 WHEN 5 THEN 0 WHEN 7 THEN 0 WHEN 10 THEN 0 WHEN 4 THEN 2 ELSE 1 END AS t FROM customer)""")
def form_notes(spark: SparkSession, d: str) -> DataFrame:
    out = files.prepare_form(_files(spark, d, "customer", ["c_custkey"], layouts.layout_file))
    return out.select(_key("c_custkey"), "fields_added", "kept_original", "notes")


@query("""WITH k AS (SELECT c_custkey, c_custkey % 12 AS layout, (c_custkey % 40)::DOUBLE AS x, (c_custkey % 60)::DOUBLE AS y, 72 + c_custkey % 40 AS left_end, 72 + c_custkey % 40 + CASE c_custkey % 12 WHEN 10 THEN 14 ELSE 24 END AS right_end FROM customer)
SELECT c_custkey, CASE layout WHEN 10 THEN 'Btn' ELSE 'Tx' END AS field_type, CASE layout WHEN 10 THEN 'Agree' ELSE 'Text1' END AS name, left_end::DOUBLE AS llx, right_end::DOUBLE AS urx FROM k WHERE layout IN (10, 11)""")
def form_widgets(spark: SparkSession, d: str) -> DataFrame:
    """The widgets that forms of squares and underscores get: their types, names and rectangles."""
    rows = _files(spark, d, "customer", ["c_custkey"], layouts.layout_file).where(F.col("path").cast("long") % 12 >= 10)
    once = files.prepare_form(rows)

    def kernel(content: bytes) -> list[tuple]:
        from foliospark.sources.pdf import load

        widgets = [v for v in load(content).objects.values() if isinstance(v, dict) and v.get("Subtype") == "Widget"]
        return [(str(w["FT"]), w["T"].decode("latin-1"), float(w["Rect"][0]), float(w["Rect"][2])) for w in widgets]

    return files.per_file(once.select("path", F.col("output").alias("content")), "field_type string, name string, llx double, urx double", kernel).select(_key("c_custkey"), "field_type", "name", "llx", "urx")


_EM = """CASE WHEN c = ' ' THEN 0.28 WHEN contains('ilIjtfr.,:;''!|', c) THEN 0.28 WHEN c IN ('_', '-') THEN 0.5 WHEN c IN ('m', 'w', 'M', 'W') THEN 0.86
  WHEN regexp_matches(c, '\\p{Lu}') THEN 0.7 WHEN regexp_matches(c, '[0-9]') THEN 0.56 ELSE 0.5 END::DOUBLE"""


def _wide(text: str, size: str, tc: str, tw: str, tz: str) -> str:
    em = _EM.replace("\\\\", "\\")
    return f"list_sum(list_transform(string_split({text}, ''), lambda c: ({em} * {size} + {tc} + CASE WHEN c = ' ' THEN {tw} ELSE 0 END) * {tz} / 100.0))"


_STATE = ("size", "tc", "tw", "tz")


@query(f"""WITH k AS (SELECT s_suppkey, s_name, (s_suppkey % 50)::DOUBLE AS x, (700 - s_suppkey % 90)::DOUBLE AS y, (8 + s_suppkey % 7)::DOUBLE AS size, (s_suppkey % 3 * 0.5)::DOUBLE AS tc, (s_suppkey % 4)::DOUBLE AS tw, (80 + s_suppkey % 5 * 10)::DOUBLE AS tz FROM supplier),
w AS (SELECT *, {_wide("s_name", *_STATE)} AS a, {_wide("'ab'", *_STATE)} AS b, {_wide("'c d'", *_STATE)} AS c, {_wide("'next'", *_STATE)} AS d, {_wide("'one two'", "size", "1", "2", "tz")} AS e, {_wide("'in a form'", "10", "0", "0", "100")} AS f FROM k),
r AS (SELECT s_suppkey, 0 AS seq, s_name AS text, x, y, a AS w FROM w
UNION ALL SELECT s_suppkey, 1, 'ab', x + a, y, b FROM w
UNION ALL SELECT s_suppkey, 2, 'c d', x + a + b + 0.5 * size * tz / 100, y, c FROM w
UNION ALL SELECT s_suppkey, 3, 'next', x, y - 14, d FROM w
UNION ALL SELECT s_suppkey, 4, 'one two', x, y - 28, e FROM w
UNION ALL SELECT s_suppkey, 5, 'in a form', x + 60, 80, f FROM w)
SELECT s_suppkey, seq::INT AS seq, text, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w FROM r""")
def shown_text(spark: SparkSession, d: str) -> DataFrame:
    """Where text stands under matrices, spacing, kerning, leading and forms; text on its side gives no run."""
    out = files.text_runs(_files(spark, d, "supplier", ["s_suppkey", "s_name"], layouts.shown_file))
    return out.select(_key("s_suppkey"), "seq", "text", *[F.round(c, 4).alias(c) for c in ("x", "y", "w")])


@query("""WITH k AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y FROM supplier)
SELECT s_suppkey, 0 AS seq, 100 + x AS llx, 100 + y AS lly, 150 + x AS urx, 120 + y AS ury FROM k
UNION ALL SELECT s_suppkey, 1, 200, 100, 230, 130 FROM k UNION ALL SELECT s_suppkey, 2, 300, 600, 320, 620 FROM k""")
def painted_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles that are stroked thinly and visibly, or filled lightly."""
    out = files.rectangles(_files(spark, d, "supplier", ["s_suppkey"], layouts.painted_file))
    return out.select(_key("s_suppkey"), "seq", "llx", "lly", "urx", "ury")


@query("""WITH k AS (SELECT s_suppkey, (s_suppkey % 50)::DOUBLE AS x, (s_suppkey % 30)::DOUBLE AS y FROM supplier)
SELECT s_suppkey, 0 AS seq, 200::DOUBLE AS x0, 400::DOUBLE AS y0, 220 + 2 * x AS x1, 400::DOUBLE AS y1, true AS horiz FROM k
UNION ALL SELECT s_suppkey, 1, 160, 500, 160, 510 + y, false FROM k UNION ALL SELECT s_suppkey, 2, 50, 600, 50, 650, false FROM k
UNION ALL SELECT s_suppkey, 3, 50, 650, 90, 650, true FROM k""")
def painted_segments(spark: SparkSession, d: str) -> DataFrame:
    """Straight level and upright segments of stroked paths, in page space."""
    out = files.segments(_files(spark, d, "supplier", ["s_suppkey"], layouts.painted_file))
    return out.select(_key("s_suppkey"), "seq", "x0", "y0", "x1", "y1", "horiz")


@query("""SELECT s_suppkey, CASE k WHEN 1 THEN 10 ELSE 0 END::DOUBLE AS llx, CASE k WHEN 1 THEN 20 ELSE 0 END::DOUBLE AS lly, CASE k WHEN 0 THEN 300 + s_suppkey % 100 WHEN 1 THEN 200 WHEN 2 THEN 500 ELSE 612 END::DOUBLE AS urx,
  CASE k WHEN 0 THEN 400 WHEN 1 THEN 250 + s_suppkey % 100 WHEN 2 THEN 700 + s_suppkey % 50 ELSE 792 END::DOUBLE AS ury, 'inherited' AS text FROM (SELECT s_suppkey, s_suppkey % 4 AS k FROM supplier)""")
def inherited_pages(spark: SparkSession, d: str) -> DataFrame:
    """Boxes and forms that pages have from their parents."""
    rows = _files(spark, d, "supplier", ["s_suppkey"], layouts.inheriting_file)
    texts = files.text_runs(rows).select("path", "text")
    return files.pages(rows).join(texts, "path").select(_key("s_suppkey"), "llx", "lly", "urx", "ury", "text")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 6 IN (0, 3, 5) THEN 1 END::BIGINT AS pages, CASE s_suppkey % 6 WHEN 1 THEN 'Encrypted' WHEN 2 THEN 'Invalid' WHEN 4 THEN 'Invalid' END AS error_class FROM supplier""")
def odd_files(spark: SparkSession, d: str) -> DataFrame:
    """Files written to a folder and read again from there; those that can't be used are rows, too."""
    folder = f"{workspace(spark)}/{uuid.uuid4().hex}"
    rows = _files(spark, d, "supplier", ["s_suppkey"], layouts.odd_file).select("path", F.col("content").alias("output"))
    _folder(folder)
    written(write_files(rows.withColumn("path", F.concat(F.lit(f"{folder}/"), "path", F.lit(".raw"))), "pdf"))
    name = F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long").alias("s_suppkey")
    return files.inspect(read_files(spark, f"{folder}/*.pdf")).select(name, "pages", "error_class")


def _folder(path: str) -> None:
    import os

    os.makedirs(path.removeprefix("file://"), exist_ok=True)


_REASONS = "CASE vec_id % 10 WHEN 1 THEN 'stencil or gray mask' WHEN 2 THEN 'stencil or gray mask' WHEN 3 THEN 'bad dimensions' WHEN 4 THEN 'unsupported filter' WHEN 5 THEN 'raw decode failed' WHEN 6 THEN 'raw decode failed' WHEN 9 THEN 'jpeg decode failed' END"


@query(f"SELECT vec_id, {_REASONS} AS skip_reason, CASE WHEN {_REASONS} IS NULL THEN 'Bitonal' END AS kind, CASE WHEN {_REASONS} IS NULL THEN repeat(lpad(lower(hex(vec_id * 7 % 256)), 2, '0'), 48) END AS pixels FROM embeddings")
def image_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Images by what keeps them from being decoded, with the pixels of the others."""
    out = files.image_table(_files(spark, d, "embeddings", ["vec_id"], layouts.image_case_file))
    return out.select(_key("vec_id"), "skip_reason", "kind", F.lower(F.hex("rgb")).alias("pixels"))


_SIDE = "CASE vec_id % 5 WHEN 0 THEN 4 WHEN 1 THEN 48 WHEN 2 THEN 8 ELSE 1920 END"


@query(f"""SELECT vec_id, false AS mask, {_SIDE}::BIGINT AS width, CASE WHEN vec_id % 5 > 2 THEN 2 ELSE {_SIDE} END::BIGINT AS height, CASE vec_id % 5 WHEN 0 THEN NULL WHEN 2 THEN 'FlateDecode' ELSE 'DCTDecode' END AS codec FROM embeddings
UNION ALL SELECT vec_id, true, 1920, 2, 'FlateDecode' FROM embeddings WHERE vec_id % 5 > 2""")
def image_choices(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of images: kept, JPEG, filtered rows, or a smaller size together with the soft mask."""
    done = files.compress(_files(spark, d, "embeddings", ["vec_id"], layouts.image_choice_file))
    rows = files.objects(done.select("path", F.col("output").alias("content"))).where("width IS NOT NULL")
    return rows.select(_key("vec_id"), (F.col("colorspace") == "DeviceGray").alias("mask"), "width", "height", F.get("filter", F.lit(0)).alias("codec"))


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN 1 WHEN vec_id % 5 >= 2 THEN 1 ELSE 0 END::BIGINT AS images_rewritten, CASE WHEN vec_id % 5 > 2 THEN 1 ELSE 0 END::BIGINT AS images_skipped FROM embeddings""")
def image_counters(spark: SparkSession, d: str) -> DataFrame:
    done = files.compress(_files(spark, d, "embeddings", ["vec_id"], layouts.image_choice_file))
    return done.select(_key("vec_id"), "images_rewritten", "images_skipped")


def _snapped(content: bytes) -> list[tuple]:
    """Colours of a JPEG of one colour, as that colour where each sample is within 3 of it."""
    import numpy as np

    from foliospark.functions import jpeg, jpeg_decode

    v = content[0]
    out = []
    for subsample in (False, True):
        for w, h in ((16, 16), (7, 5), (1, 1)):
            flat = np.tile(np.array([v, 255 - v, v // 2], np.uint8), w * h)
            got_w, got_h, channels, data = jpeg_decode.decode(jpeg.encode_rgb(w, h, flat.tobytes(), 90, subsample))
            got = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(int)
            near = (got_w, got_h, channels) == (w, h, 3) and bool((abs(got - flat.reshape(-1, 3)) <= 3).all())
            out.append((subsample, w, *((v, 255 - v, v // 2) if near else got.mean(0).round().astype(int).tolist())))
    return out


@query("""SELECT vec_id, subsample, w::INT AS w, v AS r, 255 - v AS g, v // 2 AS b FROM (SELECT vec_id, (vec_id * 11 % 256)::INT AS v FROM embeddings), (SELECT unnest([false, true]) AS subsample), (SELECT unnest([16, 7, 1]) AS w)""")
def jpeg_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colours through the JPEG encoder and a decoder, with and without halved chroma, on sides that fill no block."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.unhex(F.lpad(F.hex(F.expr("vec_id * 11 % 256")), 2, "0")).alias("content"))
    return files.per_file(rows, "subsample boolean, w int, r int, g int, b int", _snapped).select(_key("vec_id"), "subsample", "w", "r", "g", "b")
