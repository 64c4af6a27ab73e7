"""The three questions asked of files: what is in them, how small they get, which slots they have.

Each plan maps rows (path, content) to rows, file by file and without a shuffle: a file's content
is read by one task anyway, so keeping its objects there moves nothing. A file that can't be used
gives a row with ``error_class`` and ``error_msg``. Content of any length stays in small batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.functions import images
from foliospark.operators import pictures, slots
from foliospark.operators.forms import add_fields, existing_names, occupied
from foliospark.operators.graph import prune, reachable
from foliospark.operators.marks import page_box, page_marks
from foliospark.sources.pdf import Document, dump, load, refs_of
from foliospark.sources.pdfsyntax import Name, PdfError, Ref, Stream, filters_of
from foliospark.sources.pdfsyntax import operations as content_operations

BATCH_ROWS = 16
_ERRORS = "error_class string, error_msg string"


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def per_file(files: DataFrame, schema: str, kernel: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Rows (path, *kernel's columns, error_class, error_msg): ``kernel`` gives the rows of a file.

    A null content counts as no file of this kind.
    """
    out = _struct(f"path string, {schema}, {_ERRORS}")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = files.sparkSession
    if int(spark.conf.get(key)) > 1000:
        spark.conf.set(key, 1000)
    width = len(out) - 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py()
                try:
                    rows += [(name, *r, None, None) for r in kernel(content.as_py() or b"")]
                except PdfError as e:
                    rows.append((name, *[None] * width, e.kind, str(e)))
                except (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError) as e:
                    # an odd file must not end the job of all others
                    rows.append((name, *[None] * width, "Invalid", f"{type(e).__name__}: {e}"))
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, out)


# inspect


def _census(content: bytes) -> list[tuple]:
    doc = load(content)
    streams = [v for v in doc.objects.values() if isinstance(v, Stream)]
    size, n = sum(len(s.data) for s in streams), sum(pictures.is_image(s.dict) for s in streams)
    return [(len(doc.pages()), len(doc.objects), len(content), size, n, len(doc.objects) - len(reachable(doc)), f"images: {n}  stream_bytes: {size}")]


def inspect(files: DataFrame) -> DataFrame:
    """One census row a file."""
    return per_file(files, "pages long, objects long, bytes long, stream_bytes long, image_streams long, orphans long, notes string", _census)


# relations


def _tag(v) -> str:
    for kind, name in ((Stream, "stream"), (Ref, "reference"), (dict, "dictionary"), (list, "array"), (Name, "name"), (bytes, "string"), (bool, "boolean"), (int, "integer"), (float, "real")):
        if isinstance(v, kind):
            return name
    return "null"


def _objects(content: bytes) -> list[tuple]:
    doc = load(content)
    live = reachable(doc)
    out = []
    for n in sorted(doc.objects):
        v = doc.objects[n]
        d = v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}
        text = lambda k: str(d[k]) if isinstance(d.get(k), Name) else None  # noqa: B023, E731
        mask = d.get("SMask")
        out.append((n, doc.gens.get(n, 0), _tag(v), text("Type"), text("Subtype"), pictures.integer(d, "Width"), pictures.integer(d, "Height"), pictures.integer(d, "BitsPerComponent"), text("ColorSpace"), filters_of(d), mask.num if isinstance(mask, Ref) else None, len(v.data) if isinstance(v, Stream) else None, refs_of(v), n in live))
    return out


def objects(files: DataFrame) -> DataFrame:
    """One row an object, with the keys that queries ask for and the objects it refers to."""
    return per_file(files, "obj_num long, gen long, tag string, type string, subtype string, width long, height long, bpc long, colorspace string, filter array<string>, smask_ref long, stream_len long, refs array<long>, live boolean", _objects)


def _pages(doc: Document) -> list[tuple]:
    return [(no, num, *page_box(doc, num)) for no, num in enumerate(doc.pages(), 1)]


def pages(files: DataFrame) -> DataFrame:
    return per_file(files, "page_no int, obj_num long, llx double, lly double, urx double, ury double", lambda c: _pages(load(c)))


def text_runs(files: DataFrame) -> DataFrame:
    """One row a text run, in order of painting."""

    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        return [(no, seq, *t) for no, num in enumerate(doc.pages(), 1) for seq, t in enumerate(page_marks(doc, num).texts)]

    return per_file(files, "page_no int, seq int, text string, x double, y double, w double, size double, up double", kernel)


def segments(files: DataFrame) -> DataFrame:
    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        return [(no, seq, *s) for no, num in enumerate(doc.pages(), 1) for seq, s in enumerate(page_marks(doc, num).segs)]

    return per_file(files, "page_no int, seq int, x0 double, y0 double, x1 double, y1 double, horiz boolean, vert boolean", kernel)


def rectangles(files: DataFrame) -> DataFrame:
    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        return [(no, seq, *r) for no, num in enumerate(doc.pages(), 1) for seq, r in enumerate(page_marks(doc, num).rects)]

    return per_file(files, "page_no int, seq int, llx double, lly double, urx double, ury double", kernel)


def image_table(files: DataFrame) -> DataFrame:
    """One row an image object: its pixels with their kind and fingerprints, or why it was passed over."""

    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        masks = pictures.soft_masks(doc)
        out = []
        for n in sorted(doc.objects):
            if isinstance(v := doc.objects[n], Stream) and pictures.is_image(v.dict):
                i = pictures.decode(doc, n, n in masks)
                ok = i.skip_reason is None
                out.append((n, i.width, i.height, i.rgb if ok else None, i.skip_reason, i.original_len, images.fingerprint(i.rgb, i.width, i.height) if ok else None, images.fnv_fold(i.rgb) if ok else None, images.classify(i.width, i.height, i.rgb) if ok else None))
        return out

    return per_file(files, "obj_num long, width long, height long, rgb binary, skip_reason string, original_len long, fingerprint binary, fnv binary, kind string", kernel)


def fields(files: DataFrame) -> DataFrame:
    """One row a name that a file's form already has."""
    return per_file(files, "name string", lambda c: [(n,) for n in sorted(existing_names(load(c)))])


def annotations(files: DataFrame) -> DataFrame:
    """One row an annotation that keeps slots off its rectangle."""

    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        return [(no, *b) for no, num in enumerate(doc.pages(), 1) for b in occupied(doc, num)]

    return per_file(files, "page_no int, llx double, lly double, urx double, ury double", kernel)


def operations(files: DataFrame) -> DataFrame:
    """One row an operator of a page's content and how often it occurs."""

    def kernel(content: bytes) -> list[tuple]:
        doc = load(content)
        out = []
        for no, num in enumerate(doc.pages(), 1):
            try:
                out += [(no, op.decode("latin-1"), n) for op, n in Counter(op for op, _ in content_operations(doc.content(num))).items()]
            except PdfError:
                continue
        return out

    return per_file(files, "page_no int, operator string, n long", kernel)


# compress


def compressed(content: bytes) -> tuple:
    """The shorter form of a file and its counters; the file itself where it doesn't get shorter."""
    doc = load(content)
    removed = prune(doc)
    stats = pictures.process(doc)
    removed += prune(doc)
    reflated = pictures.reflate(doc)
    out = dump(doc)
    kept = len(out) >= len(content)
    out = content if kept else out
    notes = "kept original: the rewritten file is no smaller" if kept else f"orphans: {removed}  streams: {reflated}  images: {stats.rewritten}  deduped: {stats.deduped}  skipped: {stats.skipped}"
    return out, len(content), len(out), kept, removed, reflated, stats.rewritten, stats.deduped, stats.skipped, notes


def compress(files: DataFrame) -> DataFrame:
    """One row a file: the output, never longer than the input, and what was done."""
    return per_file(files, "output binary, input_bytes long, output_bytes long, kept_original boolean, orphans_removed long, streams_reflated long, images_rewritten long, images_deduped long, images_skipped long, notes string", lambda c: [compressed(c)])


# form


def slots_of(doc: Document) -> list[slots.Slot]:
    """All slots of a document, in page order, with their final names."""
    found = []
    for no, num in enumerate(doc.pages(), 1):
        found += slots.ordered(slots.propose(page_marks(doc, num), page_box(doc, num), no, occupied(doc, num)))
    return slots.named(found, existing_names(doc))


def form_fields(files: DataFrame) -> DataFrame:
    """One row a slot. A file without slots has no row."""
    return per_file(files, "field_no int, page_no int, kind string, name string, rect array<double>", lambda c: [(k, s.page_no, s.kind, s.name, list(s.rect)) for k, s in enumerate(slots_of(load(c)), 1)])


def prepared(content: bytes) -> tuple:
    """The file with a field on each slot and its counters; the file itself where it has no slot."""
    doc = load(content)
    found = slots_of(doc)
    if not found:
        return content, 0, 0, 0, True, "no empty slots found"
    add_fields(doc, found)
    n = sum(s.kind == slots.TEXT for s in found)
    return dump(doc), len(found), n, len(found) - n, False, f"fields: {len(found)}  text: {n}  checkbox: {len(found) - n}"


def prepare_form(files: DataFrame) -> DataFrame:
    return per_file(files, "output binary, fields_added long, text_fields long, checkboxes long, kept_original boolean, notes string", lambda c: [prepared(c)])
