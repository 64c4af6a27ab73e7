"""The engine's surface: SQL functions, the command line, sinks and streaming."""

import zlib

from foliospark.__main__ import main
from foliospark.api import Engine
from foliospark.plans import files
from foliospark.sources.pdf import build, load
from foliospark.streaming.ingest import arriving, keep_asking

FORM = build([b"BT /F1 12 Tf 72 700 Td (Name: ____________) Tj ET"], extra=[{"Orphan": 1}])


def test_sql_functions(spark):
    Engine(spark)
    spark.createDataFrame([("a", FORM), ("b", None), ("c", b"no pdf")], "path string, content binary").createOrReplaceTempView("given")
    got = spark.sql("SELECT zlib_compress(content) AS z, fnv_fold(content) AS f FROM given WHERE path = 'a'").first()
    assert zlib.decompress(bytes(got["z"])) == FORM and len(got["f"]) == 32
    assert spark.sql("SELECT g.path, o.* FROM given g, LATERAL pdf_objects(g.content) o WHERE o.subtype = 'Type1'").count() == 1
    assert [r["text"] for r in spark.sql("SELECT m.text, m.seq FROM given g, LATERAL page_marks(g.content) m ORDER BY m.seq").collect()] == ["Name: ", "____________"]
    raster = "unhex(repeat('10', 192))"
    r = spark.sql(f"SELECT ssim(8, 8, {raster}, {raster}) AS s, classify_image(8, 8, {raster}) AS k, length(jpeg_encode({raster}, 8, 8, 80)) AS n").first()
    assert r["s"] == 1.0 and r["k"] == "Bitonal" and r["n"] > 100


def test_sql_marks_checksums_and_labels(spark):
    Engine(spark)
    page = build([b"BT /F1 12 Tf 72 700 Td (Hi) Tj ET 72 640 14 14 re S 100 100 m 200 100 l S"])
    spark.createDataFrame([("a", page), ("b", None)], "path string, content binary").createOrReplaceTempView("pages_given")
    got = spark.sql("SELECT m.kind, m.x0, m.y0, m.x1, m.y1 FROM pages_given g, LATERAL page_marks(g.content) m").collect()
    assert {r["kind"]: tuple(r)[1:] for r in got if r["kind"] != "text"} == {"rectangle": (72, 640, 86, 654), "segment": (100, 100, 200, 100)}
    r = spark.sql("SELECT adler32(CAST('abc' AS BINARY)) AS a, adler32(CAST(NULL AS BINARY)) AS n, sanitize_label(' * Your name: ') AS s, sanitize_label('...') AS e").first()
    assert (r["a"], r["n"], r["s"], r["e"]) == (zlib.adler32(b"abc"), None, "Your name", None)


def test_one_odd_file_ends_no_job(spark):
    from foliospark.sources.layouts import odd_file

    rows = spark.createDataFrame([(str(k), odd_file(k)) for k in range(12)], "path string, content binary")
    for plan in (files.inspect, files.compress, files.prepare_form, files.objects, files.image_table):
        got = {int(r["path"]): r["error_class"] for r in plan(rows).collect()}
        assert {k: v for k, v in got.items() if v} == {1: "Encrypted", 2: "Invalid", 4: "Invalid", 7: "Encrypted", 8: "Invalid", 10: "Invalid"}

    def raising(content):
        raise KeyError("odd")

    assert {r["error_class"] for r in files.per_file(rows, "x long", raising).collect()} == {"Invalid"}


def test_reports_beyond_the_screen_are_written_whole(spark, capsys, monkeypatch):
    from foliospark import __main__

    monkeypatch.setattr(__main__, "SHOWN", 3)
    __main__.show(spark.range(10))
    out = capsys.readouterr().out
    assert "7 more rows are in " in out
    assert spark.read.parquet(out.rsplit(" in ", 1)[1].strip()).count() == 10


def test_output_path_and_mounts(spark, tmp_path):
    import pytest

    from foliospark.sources.sinks import write_files

    (tmp_path / "x.pdf").write_bytes(FORM)
    assert main(["form", str(tmp_path / "x.pdf"), "-o", str(tmp_path / "to.pdf")]) == 0
    assert len(load((tmp_path / "to.pdf").read_bytes()).pages()) == 1 and not (tmp_path / "x.form.pdf").exists()
    (tmp_path / "y.pdf").write_bytes(FORM)
    with pytest.raises(SystemExit):
        main(["form", str(tmp_path / "*.pdf"), "--output", str(tmp_path / "to2.pdf")])
    rows = spark.createDataFrame([("s3a://bucket/x.pdf", FORM)], "path string, output binary")
    with pytest.raises(Exception, match="no mounted folder"):
        write_files(rows, "form.pdf").collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.pdf").write_bytes(FORM)
    assert main(["inspect", str(tmp_path / "x.pdf")]) == 0
    assert main(["compress", str(tmp_path / "x.pdf"), "--report"]) == 0
    assert main(["form", str(tmp_path / "x.pdf"), "--report"]) == 0
    shown = capsys.readouterr().out
    assert "orphans: 1" in shown and "Name" in shown
    assert len((tmp_path / "x.folio.pdf").read_bytes()) < len(FORM)
    assert len(load((tmp_path / "x.form.pdf").read_bytes()).pages()) == 1
    (tmp_path / "y.pdf").write_bytes(b"not a pdf")
    assert main(["compress", str(tmp_path / "y.pdf")]) == 1 and not (tmp_path / "y.folio.pdf").exists()


def test_streaming_asks_each_file_once(spark, tmp_path):
    source, to = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.pdf").write_bytes(FORM)
        keep_asking(files.inspect, arriving(spark, str(source)), to, str(tmp_path / "state")).awaitTermination(120)
        assert spark.read.parquet(to).count() == k + 1
