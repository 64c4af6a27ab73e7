"""Files end to end: what is found in them, what forms get, how they shrink, and what is refused."""

import zlib

import pytest

from foliospark.operators.graph import closure, reachable
from foliospark.operators.marks import page_marks
from foliospark.operators.slots import CHECKBOX, TEXT, merged_lines, named, sanitize, Slot, Box
from foliospark.plans import files
from foliospark.sources.pdf import Document, build, dump, load, output_path, refs_of
from foliospark.sources.pdfsyntax import Encrypted, Invalid, Name, Reader, Ref, Stream, decoded, encoded, operations


def text(x, y, t, size=12):
    return f"BT /F1 {size} Tf {x} {y} Td ({t}) Tj ET\n".encode()


def line(x0, x1, y):
    return f"{x0} {y} m {x1} {y} l S\n".encode()


def fields(content, **more):
    return [(s.kind, s.name) for s in files.slots_of(load(build([content], **more)))]


def test_underscores_lines_and_boxes():
    assert fields(text(72, 700, "Name: ____________") + text(72, 660, "Email: ___________")) == [(TEXT, "Name"), (TEXT, "Email")]
    assert fields(text(72, 700, "Name") + line(140, 360, 698) + b"72 640 14 14 re S\n" + text(96, 642, "Agree")) == [(TEXT, "Name"), (CHECKBOX, "Agree")]
    found = files.slots_of(load(build([text(72, 720, "Notes") + b"72 640 220 60 re S"])))
    assert [(s.kind, s.name) for s in found] == [(TEXT, "Notes")] and found[0].rect.ury - found[0].rect.lly > 40
    four = line(100, 300, 600) + line(100, 300, 640) + b"100 600 m 100 640 l S 300 600 m 300 640 l S\n"
    assert fields(text(100, 650, "Office") + four) == [(TEXT, "Office")]


@pytest.mark.parametrize("content", [b"2 2 608 788 re S", text(72, 700, "Plain prose without any slot."), text(72, 700, "Underlined") + line(72, 150, 697), b"72 640 220 60 re S" + text(120, 665, "Inside the box")])
def test_pages_without_slots(content):
    assert fields(content) == []
    data = build([content])
    assert files.prepared(data)[0] == data


def test_transforms_and_forms():
    found = files.slots_of(load(build([b"1 0 0 1 100 0 cm\n" + text(20, 700, "City") + line(60, 260, 698)])))
    assert [s.name for s in found] == ["City"] and found[0].rect.llx > 120
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 50, 0]}, text(20, 700, "City") + line(60, 260, 698))
    assert fields(b"/Im1 Do", images=[[form]]) == [(TEXT, "City")]


def test_a_form_that_draws_itself_ends():
    doc = load(build([b"/Im1 Do"], images=[[Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"Im1": Ref(4, 0)}}}, text(1, 1, "once") + b"/Im1 Do")]]))
    assert [t.text for t in page_marks(doc, doc.pages()[0]).texts] == ["once"]


def test_form_is_idempotent():
    once = files.prepared(build([text(72, 700, "Name: ____________")]))
    assert once[1] == 1 and files.prepared(once[0])[0] == once[0]
    doc = load(once[0])
    form = doc.dict_of(doc.dict_of(doc.trailer["Root"])["AcroForm"])
    assert form["NeedAppearances"] is True and len(form["Fields"]) == 1 and doc.dict_of(form["Fields"][0])["T"] == b"Name"


def test_names():
    slot = lambda n, k=TEXT: Slot(1, k, Box(0, 0, 1, 1), n)
    got = named([slot("A"), slot("A"), slot(""), slot("", CHECKBOX), slot("A_2"), slot("Text1")], {"Text1"})
    assert [s.name for s in got] == ["A", "A_2", "Text2", "Check1", "A_2_2", "Text1_2"]
    assert [sanitize(t) for t in (" * Name: ", "a.b", "...", "one two three four five six seven eight nine", "x" * 49, "a\x07 \t b")] == ["Name", "a_b", None, None, None, "a b"]
    assert merged_lines([(0, 10, 5), (1, 12, 6), (50, 60, 5.5)]) == [(0, 10, 5), (50, 60, 5.5), (1, 12, 6)]


def test_compress_drops_orphans_and_merges_images():
    image = Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 32, "Height": 32, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}, bytes(k % 251 for k in range(3072)))
    data = build([b"/Im1 Do", b"/Im1 Do"], images=[[image], [image]], extra=[{"Orphan": 1}])
    out, size, new, kept, orphans, _, rewritten, deduped, skipped, _ = files.compressed(data)
    assert (orphans, deduped, skipped, kept) == (1, 1, 0, False) and new < size and rewritten == 1
    assert len(load(out).pages()) == 2 and b"\nxref\n" in out
    small = files.compressed(out)
    assert len(small[0]) <= len(out)


def test_unsupported_images_are_skipped_with_a_reason():
    from foliospark.operators.pictures import decode

    base = {"Subtype": Name("Image"), "Width": 4, "Height": 4, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}
    cases = [({"ImageMask": True}, "stencil or gray mask"), ({"Width": 0}, "bad dimensions"), ({"Filter": Name("CCITTFaxDecode")}, "unsupported filter"), ({"ColorSpace": Name("DeviceCMYK")}, "raw decode failed"), ({}, None)]
    for more, reason in cases:
        doc = Document({1: Stream(base | more, bytes(48))}, {}, {})
        assert decode(doc, 1, False).skip_reason == reason


def test_broken_flate_content_is_left_alone():
    data = build([b"x"])
    doc = load(data)
    for n, v in doc.objects.items():
        if isinstance(v, Stream):
            doc.objects[n] = Stream({"Filter": Name("FlateDecode")}, b"no zlib data at all" * 9)
    out = files.compressed(dump(doc))[0]
    assert any(isinstance(v, Stream) and v.data == b"no zlib data at all" * 9 for v in load(out).objects.values())


def test_reading_variants():
    plain = build([text(72, 700, "Hi")], extra=[{"Lost": 1}])
    assert len(load(plain.replace(b"startxref", b"startxxxx")).objects) == len(load(plain).objects)
    with pytest.raises(Encrypted):
        load(plain.replace(b"/Size", b"/Encrypt 1 0 R/Size"))
    for bad in (b"", b"not a pdf", b"%PDF-1.4\nnothing"):
        with pytest.raises(Invalid):
            load(bad)
    doc = load(plain)
    inner = {n: v for n, v in doc.objects.items() if not isinstance(v, Stream)}
    parts, table, at = [], [], 0
    for n, v in inner.items():
        e = encoded(v) + b" "
        table.append(b"%d %d " % (n, at))
        parts.append(e)
        at += len(e)
    head = b"".join(table)
    holder = Stream({"Type": Name("ObjStm"), "N": len(inner), "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(head + b"".join(parts)))
    out, offsets = b"%PDF-1.5\n", {}
    streams = {n: v for n, v in doc.objects.items() if isinstance(v, Stream)} | {90: holder}
    for n, v in streams.items():
        offsets[n] = len(out)
        out += b"%d 0 obj\n" % n + encoded(v) + b"\nendobj\n"
    rows = b""
    for n in range(92):
        kind, a, b = (1, offsets[n], 0) if n in offsets else (2, 90, list(inner).index(n)) if n in inner else (1, len(out), 0) if n == 91 else (0, 0, 0)
        rows += bytes([kind]) + a.to_bytes(3) + bytes([b])
    start = len(out)
    xref = Stream({"Type": Name("XRef"), "Size": 92, "W": [1, 3, 1], "Root": doc.trailer["Root"], "Filter": Name("FlateDecode")}, zlib.compress(rows))
    out += b"91 0 obj\n" + encoded(xref) + b"\nendobj\nstartxref\n%d\n%%%%EOF" % start
    again = load(out)
    assert len(again.pages()) == 1 and again.content(again.pages()[0]) == text(72, 700, "Hi") and reachable(again) == reachable(doc)


def test_syntax_round_trip():
    v = {"A": [1, -2.5, True, None, Name("a b#("), b"x(y)\\z", b"\xfe\xff\x00", Ref(3, 0)], "B": {"C": []}}
    assert Reader(encoded(v)).value() == v
    assert Reader(b"(a\\051\\n(b)\\\r\nc)").value() == b"a)\n(b)c" and Reader(b"<4 1 4>").value() == b"A@"
    assert operations(b"q 1 0 0 1 0 0 cm BI /W 1 ID \x00\xff EI Q") [-1] == (b"Q", [])
    for bad in (b"[1 2", b"<< /A >>", b"(never", b"1 ]"):
        with pytest.raises(Invalid):
            operations(bad)
    assert decoded(Stream({"Filter": [Name("ASCIIHexDecode"), Name("RunLengthDecode")]}, b"02 61 62 63 FE 7A 80>")) == b"abczzz"
    assert decoded(Stream({"Filter": Name("LZWDecode")}, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))) == b"-----A---B"
    assert refs_of({"a": [Ref(2, 0), {"b": Ref(3, 0)}], "c": Ref(2, 0)}) == [2, 3, 2]


def test_plans_over_tables(spark, tmp_path):
    good = build([text(72, 700, "Name: ____________")])
    (tmp_path / "a.pdf").write_bytes(good)
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    from foliospark.sources.pdf import read_files

    rows = read_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.inspect(rows).collect()}
    assert got["a.pdf"]["pages"] == 1 and got["a.pdf"]["bytes"] == len(good) and got["b.pdf"]["error_class"] == "Invalid"
    with_null = spark.createDataFrame([("x", good), ("y", None)], "path string, content binary")
    assert files.form_fields(with_null).where("name = 'Name'").count() == 1
    assert files.compress(with_null.limit(0)).count() == 0
    assert [r[0] for r in with_null.limit(1).selectExpr("'d/e.old.pdf' AS p").select(output_path("p", "form.pdf")).collect()] == ["d/e.old.form.pdf"]
    runs = files.text_runs(with_null).where("text IS NOT NULL").orderBy("seq").collect()
    assert [r["text"] for r in runs] == ["Name: ", "____________"]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 1)], "src long, dst long")
    got = closure(edges, spark.createDataFrame([(1,), (1,), (None,)], "node long"))
    assert sorted(r["node"] for r in got.collect()) == [1, 2, 3]
    assert closure(edges, spark.createDataFrame([], "node long")).count() == 0


def test_closure_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)], "src long, dst long")
    assert closure(edges, spark.createDataFrame([(0,)], "node long")).count() == 21


def test_parameters_may_be_references_and_names():
    from foliospark.operators.pictures import decode, gray_samples

    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1])
    s = Stream({"Filter": Ref(8, 0), "DecodeParms": Ref(9, 0)}, zlib.compress(rows))
    doc = Document({1: s, 8: Name("FlateDecode"), 9: {"Predictor": Ref(7, 0), "Columns": Ref(6, 0)}, 7: 12, 6: 3}, {}, {})
    assert doc.data(s) == bytes([1, 2, 3, 2, 3, 4])
    with pytest.raises(Invalid):
        decoded(Stream({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 10**12}}, zlib.compress(rows)))
    odd = Stream({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": Name("x"), "Columns": [1]}}, zlib.compress(rows))
    assert decoded(odd) == rows
    base = {"Subtype": Name("Image"), "Width": 2, "Height": 2, "BitsPerComponent": 8}
    for space, n, reason in (([Name("ICCBased"), Ref(7, 0)], 12, None), ([Name("Indexed"), Name("DeviceRGB")], 4, "raw decode failed"), ([Name("CalGray"), {}], 4, None), (Name("DeviceGrey"), 4, None), (None, 12, None)):
        image = Document({1: Stream(base | ({"ColorSpace": space} if space else {}), bytes(n))}, {}, {})
        assert decode(image, 1, False).skip_reason == reason
    from foliospark.functions import jpeg

    mask = Stream(base | {"Width": 8, "Height": 8, "Filter": Name("DCTDecode")}, jpeg.encode_rgb(8, 8, bytes([90] * 192), 95))
    got = gray_samples(Document({}, {}, {}), mask, 8, 8)
    assert len(got) >= 64 and all(abs(x - 90) < 4 for x in got[:64])
    assert gray_samples(Document({}, {}, {}), mask, 9, 8) is None
