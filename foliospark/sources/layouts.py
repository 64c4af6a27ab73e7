"""Pages whose marks, slots, boxes and images follow from a key by rules that SQL can state."""

from __future__ import annotations

from foliospark.functions import jpeg
from foliospark.sources.pdf import Document, build, dump, load
from foliospark.sources.pdfsyntax import Name, Ref, Stream, bytes_of, encoded

LAYOUTS = 12


def _text(x: float, y: float, text: str, size: int = 12) -> bytes:
    return b"BT /F1 %d Tf %g %g Td %s Tj ET\n" % (size, x, y, encoded(bytes_of(text)))


def _line(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return b"%g %g m %g %g l S\n" % (x0, y0, x1, y1)


def _box(x: float, y: float, w: float, h: float) -> bytes:
    return b"%g %g %g %g re S\n" % (x, y, w, h)


def layout_file(key: int) -> bytes:
    """One page of the layout key % LAYOUTS, moved by key % 40 to the right and key % 60 down."""
    x, y = key % 40, key % 60
    rows = [y_ - y for y_ in (640, 600, 560)]
    content = [
        lambda: _text(72 + x, 700 - y, "Name", 8 + key % 12) + _line(140 + x, 698 - y, 360 + x, 698 - y),
        lambda: _text(72 + x, 700 - y, "Underlined") + _line(72 + x, 697 - y, 132 + x, 697 - y),
        lambda: _text(72 + x, 700 - y, "Phone") + _line(130 + x, 698 - y, 330 + x, 698 - y) + _line(135 + x, 699 - y, 360 + x, 699 - y),
        lambda: _text(72 + x, 700 - y, "City") + _box(110 + x, 697 - y, 200, 2),
        lambda: _text(100 + x, 650 - y, "Office") + b"".join(_line(100 + x, r, 300 + x, r) for r in rows) + b"".join(_line(c + x, rows[2], c + x, rows[0]) for c in (100, 300)),
        lambda: _box(72 + x, 640 - y, 220, 60) + _text(120 + x, 665 - y, "Inside"),
        lambda: _text(72 + x, 720 - y, "Notes") + _box(72 + x, 640 - y, 220, 60) + _line(72 + x, 640 - y, 292 + x, 640 - y),
        lambda: _box(2, 2, 608, 788),
        lambda: _text(72 + x, 720 - y, "Notes") + _box(72 + x, 640 - y, 220, 60) + _box(74 + x, 642 - y, 218, 58),
        lambda: _text(72 + x, 700 - y, "First") + _text(101 + x, 700 - y, "Name") + _line(140 + x, 698 - y, 360 + x, 698 - y),
        lambda: _box(72 + x, 640 - y, 14, 14) + _text(96 + x, 642 - y, "Agree"),
        lambda: _text(72 + x, 700 - y, "____"),
    ]
    return build([content[key % LAYOUTS]()])


def shown_file(key: int, name: str) -> bytes:
    """Text under every state that moves it, text on its side, and text in a form that is drawn."""
    x, y = key % 50, 700 - key % 90
    states = b"/F1 %d Tf %g Tc %d Tw %d Tz 14 TL" % (8 + key % 7, key % 3 * 0.5, key % 4, 80 + key % 5 * 10)
    content = b"BT %s 1 0 0 1 %d %d Tm %s Tj [(ab) -500 (c d)] TJ (next) ' 2 1 (one two) \" ET\n" % (states, x, y, encoded(bytes_of(name)))
    content += b"BT /F1 12 Tf 0 1 -1 0 300 300 Tm (on its side) Tj ET\nq 1 0 0 1 %d 0 cm /Im1 Do Q\n" % x
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 50, 60]}, b"BT /F1 10 Tf 10 20 Td (in a form) Tj ET /Im1 Do")
    return build([content], images=[[form]])


def painted_file(key: int) -> bytes:
    """Paths that are painted so that they show, and others that don't."""
    x, y = key % 50, key % 30
    return build([
        b"q 1 0 0 1 %d %d cm 100 100 50 20 re S Q\n" % (x, y)
        + b"1 g 200 100 30 30 re f 0 g 240 100 30 30 re f\nq 2 0 0 2 0 0 cm 100 200 m %d 200 l S Q\n" % (110 + x)
        + b"10 w 300 300 40 40 re S 1 w 1 G 300 400 40 40 re S 0 G\n100 500 m 120 500 140 520 160 500 c 160 %d l S\n" % (510 + y)
        + b"50 600 m 50 650 l 90 650 l h S\n70 700 40 20 re n\n0 0 0 0 k 300 600 20 20 re B 0.5 0.5 0.5 rg 330 600 20 20 re f\n"
    ])


def inheriting_file(key: int) -> bytes:
    """A page three levels below the catalog, whose box and form come from the level that key % 4 names."""
    kind = key % 4
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form")}, b"BT /F1 10 Tf 10 20 Td (inherited) Tj ET")
    page = {"Type": Name("Page"), "Parent": Ref(3, 0), "Contents": Ref(5, 0)} | ({"MediaBox": [0, 0, 300 + key % 100, 400]} if kind in (0, 1) else {})
    parent = {"Type": Name("Pages"), "Parent": Ref(2, 0), "Kids": [Ref(4, 0)], "Count": 1} | ({"CropBox": [10, 20, 200, 250 + key % 100]} if kind == 1 else {})
    root = {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "Resources": {"XObject": {"Fm": Ref(6, 0)}}} | ({"MediaBox": [500, 700 + key % 50, 0, 0]} if kind in (1, 2) else {})
    objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: root, 3: parent, 4: page, 5: Stream({}, b"/Fm Do"), 6: form}
    return dump(Document(objects, {"Root": Ref(1, 0)}, dict.fromkeys(objects, 0)))


def odd_file(key: int) -> bytes:
    """A good file, an encrypted one, no file of this kind, one without its cross-references, one cut off, or one
    whose parameters are references and names."""
    good = build([_text(72, 700, "Hi")])
    if key % 6 == 5:
        doc = load(good)
        top = max(doc.objects)
        for v in list(doc.objects.values()):
            if isinstance(v, Stream):
                v.dict.update({"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": Ref(top + 1, 0), "Columns": Name("Odd")}})
        doc.objects[top + 1] = 15
        return dump(doc)
    return [good, good.replace(b"/Size", b"/Encrypt 1 0 R/Size"), b"not a pdf", good.replace(b"startxref", b"startxxxx"), good[:40]][key % 6]


_IMAGE = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 4, "Height": 4, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8}


def _one_image(d: dict, data: bytes, mask: Stream | None = None) -> bytes:
    doc = load(build([b"/Im1 Do"], images=[[Stream(dict(d), data)]]))
    if mask:
        num = max(doc.objects) + 1
        next(v for v in doc.objects.values() if isinstance(v, Stream) and "Width" in v.dict).dict["SMask"] = Ref(num, 0)
        doc.objects[num] = mask
    return dump(doc)


def image_case_file(key: int) -> bytes:
    """An image of 4 by 4 points that key % 10 makes readable or not."""
    gray = bytes(key * 7 % 256 for _ in range(16))
    cases = [
        ({}, gray * 3), ({"ImageMask": True}, gray), ({"Mask": [0, 1]}, gray * 3), ({"Width": 0}, gray * 3), ({"Filter": Name("CCITTFaxDecode")}, gray),
        ({"ColorSpace": Name("DeviceCMYK")}, gray * 4), ({"ColorSpace": [Name("ICCBased"), Ref(1, 0)]}, gray), ({"ColorSpace": [Name("CalGray"), {}]}, gray),
        ({"Subtype": None}, gray * 3), ({"Filter": Name("DCTDecode")}, gray),
    ]
    more, data = cases[key % 10]
    return _one_image({k: v for k, v in (_IMAGE | more).items() if v is not None}, data)


def image_choice_file(key: int) -> bytes:
    """An image that key % 5 lets stay, turn to JPEG, turn to filtered rows, or shrink together with a soft mask of
    raw samples or of JPEG."""
    kind, v = key % 5, key * 11 % 256
    noise = bytes((key * 31 + k * 97 + k * k * 53) % 256 for k in range(48))
    if kind == 0:
        return _one_image(_IMAGE, noise)
    w, h = (48, 48) if kind == 1 else (8, 8) if kind == 2 else (2000, 2)
    mask = None
    if kind > 2:
        gray = bytes([200]) * (w * h)
        d = _IMAGE | {"Width": w, "Height": h, "ColorSpace": Name("DeviceGray")}
        mask = Stream(dict(d), gray) if kind == 3 else Stream(d | {"Filter": Name("DCTDecode")}, jpeg.encode_rgb(w, h, bytes([200]) * (w * h * 3), 90))
    return _one_image(_IMAGE | {"Width": w, "Height": h}, bytes([v, 255 - v, v // 2]) * (w * h), mask)
