"""The engine over a session: the three questions, and its functions by name in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import deflate, images, jpeg, native
from foliospark.operators import slots
from foliospark.plans import files
from foliospark.sources.pdf import load, read_files
from foliospark.sources.pdfsyntax import PdfError


def _binary(kernel):
    """An Arrow function from binary to binary that the planner runs once: null stays null."""

    @F.pandas_udf(T.BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else kernel(bytes(x)))

    return run.asNondeterministic()


@F.pandas_udf(T.BinaryType())
def _jpeg_encode(rgb: pd.Series, width: pd.Series, height: pd.Series, quality: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else jpeg.encode_rgb(w, h, bytes(x), q) for x, w, h, q in zip(rgb, width, height, quality, strict=True)], dtype=object)


@F.pandas_udf(T.DoubleType())
def _ssim(width: pd.Series, height: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else images.ssim(w, h, bytes(x), bytes(y)) for w, h, x, y in zip(width, height, a, b, strict=True)], dtype=float)


@F.pandas_udf(T.StringType())
def _classify(width: pd.Series, height: pd.Series, rgb: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else images.classify(w, h, bytes(x)) for w, h, x in zip(width, height, rgb, strict=True)], dtype=object)


@F.udtf(returnType="obj_num long, tag string, subtype string, stream_len long, refs array<long>")
class PdfObjects:
    """Rows of the objects of a file; none for content that is no readable file."""

    def eval(self, content: bytes):
        if content is not None:
            try:
                for r in files._objects(bytes(content)):
                    yield r[0], r[2], r[4], r[11], r[12]
            except PdfError:
                return


@F.pandas_udf(T.StringType())
def _sanitize(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else slots.sanitize(x))


@F.udtf(returnType="page_no int, seq int, kind string, text string, x0 double, y0 double, x1 double, y1 double, size double, up double")
class PageMarks:
    """Rows of the marks of a file's pages: text runs, rectangles and segments, each kind in order of painting."""

    def eval(self, content: bytes):
        from foliospark.operators.marks import page_marks

        if content is not None:
            try:
                doc = load(bytes(content))
            except PdfError:
                return
            for no, num in enumerate(doc.pages(), 1):
                marks = page_marks(doc, num)
                for seq, t in enumerate(marks.texts):
                    yield no, seq, "text", t.text, t.x, t.y, t.x + t.w, t.y, t.size, t.up
                for seq, r in enumerate(marks.rects):
                    yield no, seq, "rectangle", None, r.llx, r.lly, r.urx, r.ury, None, None
                for seq, s in enumerate(marks.segs):
                    yield no, seq, "segment", None, s.x0, s.y0, s.x1, s.y1, None, None


zlib_compress, fnv_fold = _binary(deflate.compress), _binary(images.fnv_fold)
jpeg_encode, ssim, classify_image = _jpeg_encode.asNondeterministic(), _ssim.asNondeterministic(), _classify.asNondeterministic()


class Engine:
    """Plans over files, given as a path or as rows (path, content)."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        for name, f in {"zlib_compress": zlib_compress, "fnv_fold": fnv_fold, "jpeg_encode": jpeg_encode, "ssim": ssim, "classify_image": classify_image, "adler32": native._adler32, "sanitize_label": _sanitize}.items():
            spark.udf.register(name, f)
        spark.udtf.register("pdf_objects", PdfObjects)
        spark.udtf.register("page_marks", PageMarks)

    def files(self, source: str | DataFrame) -> DataFrame:
        return read_files(self.spark, source) if isinstance(source, str) else source

    def inspect(self, source: str | DataFrame) -> DataFrame:
        return files.inspect(self.files(source))

    def compress(self, source: str | DataFrame) -> DataFrame:
        return files.compress(self.files(source))

    def form_fields(self, source: str | DataFrame) -> DataFrame:
        return files.form_fields(self.files(source))

    def prepare_form(self, source: str | DataFrame) -> DataFrame:
        return files.prepare_form(self.files(source))


def rect_text(rect: Column) -> Column:
    """A rectangle as its report shows it, one digit after the point."""
    return F.concat(F.lit("["), F.array_join(F.transform(rect, lambda x: F.format_string("%.1f", x)), ", "), F.lit("]"))
