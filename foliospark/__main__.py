"""python -m foliospark inspect|compress|form PATH [-o OUTPUT] [--report]

Reports of up to SHOWN rows are shown; longer ones are shown in part, which is said, and written whole as Parquet.
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.api import Engine, rect_text
from foliospark.sources.sinks import write_files
from foliospark.sources.storage import workspace, written


SHOWN = 1000


def show(report: DataFrame) -> None:
    """A report on the screen, or its beginning and the table that has all of it."""
    if len(report.take(SHOWN + 1)) <= SHOWN:
        report.show(SHOWN, truncate=False)
        return
    path = f"{workspace(report.sparkSession)}/report-{uuid.uuid4().hex}"
    report.write.parquet(path)
    whole = report.sparkSession.read.parquet(path)
    whole.show(SHOWN, truncate=False)
    print(f"{whole.count() - SHOWN} more rows are in {path}")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("command", choices=["inspect", "compress", "form"])
    p.add_argument("path", help="a file, a folder or a pattern")
    p.add_argument("-o", "--output", help="where the one file that PATH names is written, instead of beside it")
    p.add_argument("--report", action="store_true", help="show what was done")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    engine = Engine(spark)
    if args.command == "inspect":
        done = engine.inspect(args.path)
        show(done)
        return int(not done.where("error_class IS NOT NULL").isEmpty())
    plan, suffix = (engine.compress, "folio.pdf") if args.command == "compress" else (engine.prepare_form, "form.pdf")
    done = written(plan(args.path))
    if args.output and done.count() != 1:
        p.error("--output takes one file")
    write_files(done, suffix, args.output).write.format("noop").mode("overwrite").save()
    wrong = done.where("error_class IS NOT NULL").select("path", "error_class", "error_msg")
    shown = done if args.report else done.where("kept_original")
    show(shown.drop("output"))
    if args.report and args.command == "form":
        show(engine.form_fields(args.path).withColumn("rect", rect_text(F.col("rect"))))
    if wrong.isEmpty():
        return 0
    show(wrong)
    return 1


if __name__ == "__main__":
    raise SystemExit(main())
