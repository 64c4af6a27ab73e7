"""Writing produced files next to their inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.pdf import output_path


def write_files(done: DataFrame, suffix: str, to: str | None = None) -> DataFrame:
    """Writes ``output`` of rows (path, output) beside each path, its extension replaced by ``suffix``,
    or a single row to the path ``to``.

    The executors write to a mounted folder that all of them see: a path without a scheme or with file:.
    Any other scheme raises, as Python can't write there. A file is written under another name and then
    renamed, so a repeated task leaves no half a file. Returns (path, written_to, bytes) lazily;
    rows without output are passed over.
    """
    rows = done.where("output IS NOT NULL").select("path", (F.lit(to) if to else output_path("path", suffix)).alias("written_to"), "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re
        import uuid

        for batch in batches:
            sizes = []
            for to, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                scheme, colon, rest = to.partition(":")
                if colon and scheme.isalnum() and scheme != "file":
                    raise ValueError(f"no mounted folder: {to}")
                local, content = (re.sub("^/+", "/", rest) if colon and scheme == "file" else to), data.as_py()
                draft = f"{local}.{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    f.write(content)
                os.replace(draft, local)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["path", "written_to", "bytes"])

    return rows.mapInArrow(run, "path string, written_to string, bytes long")
