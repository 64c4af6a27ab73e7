"""Files made from table rows inside a Spark job, so that what is in them follows from the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.pdf import build, dump, load
from foliospark.sources.pdfsyntax import Name, Ref, Stream, bytes_of, encoded
from foliospark.sources.storage import spread

LINES = 40
SIDE = 8


def made(rows: DataFrame, columns: list[str], kernel: Callable[..., bytes]) -> DataFrame:
    """(path, content) from rows whose first column becomes the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in values[0]]), pa.array([kernel(*r) for r in zip(*values, strict=True)], pa.binary())], names=["path", "content"])

    return spread(rows.select(*columns)).mapInArrow(run, "path string, content binary")


def text_file(doc_id: int, text: str | None) -> bytes:
    """LINES lines of text a page, and doc_id % 3 objects that nothing refers to."""
    lines = (text or "").split("\n")
    pages = []
    for at in range(0, len(lines), LINES):
        shown = b"".join(encoded(bytes_of(x)) + b" Tj T*\n" for x in lines[at : at + LINES])
        pages.append(b"BT /F1 10 Tf 12 TL 72 740 Td\n" + shown + b"ET")
    return build(pages, extra=[{"Orphan": k} for k in range(doc_id % 3)])


def form_file(key: int, name: str) -> bytes:
    """A line to fill in, labelled by a name, and a square labelled Agree."""
    return build([b"BT /F1 12 Tf 72 700 Td " + encoded(bytes_of(f"{name}: ____________")) + b" Tj ET 72 640 14 14 re S BT /F1 12 Tf 96 642 Td (Agree) Tj ET"])


def image_file(key: int, vector: list[float], label: int) -> bytes:
    """A page with the vector as an 8 by 8 gray raster, as often as the label says, and once more."""
    low, high = min(vector), max(vector)
    data = bytes(int((x - low) / ((high - low) or 1.0) * 255) for x in vector[: SIDE * SIDE])
    d = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": SIDE, "Height": SIDE, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}
    return build([b"q 100 0 0 100 72 600 cm /Im1 Do Q"], images=[[Stream(dict(d), data) for _ in range(label + 1)]])


def hex_file(doc_id: int, text: str | None) -> bytes:
    """A page whose content is hexadecimal, so that deflating it anew always pays."""
    body = b"BT /F1 10 Tf 72 740 Td " + encoded(bytes_of(text or "")) + b" Tj ET"
    doc = load(build([body]))
    doc.objects = {n: Stream({"Filter": Name("ASCIIHexDecode")}, v.data.hex().encode() + b">") if isinstance(v, Stream) else v for n, v in doc.objects.items()}
    return dump(doc)


def masked_file(key: int, label: int) -> bytes:
    """A page with label + 1 images that share one soft mask."""
    gray = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": 2, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}
    doc = load(build([b""], images=[[Stream(dict(gray), bytes([k] * 4)) for k in range(label + 1)]]))
    mask = max(doc.objects) + 1
    for v in doc.objects.values():
        if isinstance(v, Stream) and v.dict.get("Subtype") == "Image":
            v.dict["SMask"] = Ref(mask, 0)
    doc.objects[mask] = Stream(dict(gray), bytes(4))
    return dump(doc)


def hex_files(documents: DataFrame) -> DataFrame:
    return made(documents, ["doc_id", "text"], hex_file)


def masked_files(embeddings: DataFrame) -> DataFrame:
    return made(embeddings, ["vec_id", "label"], masked_file)


def text_files(documents: DataFrame) -> DataFrame:
    return made(documents, ["doc_id", "text"], text_file)


def form_files(customer: DataFrame) -> DataFrame:
    return made(customer, ["c_custkey", "c_name"], form_file)


def image_files(embeddings: DataFrame) -> DataFrame:
    return made(embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"), ["vec_id", "embedding", "label"], image_file)
