"""Drawing marks of a page: text runs, straight segments and rectangles, in order of painting.

The machine keeps the graphics state a content stream sets up and turns its operators into rows.
Every mark carries ``seq``, its place among the marks of its kind: later steps break ties by it.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import NamedTuple

from foliospark.sources.pdf import Document
from foliospark.sources.pdfsyntax import Name, PdfError, Ref, Stream, operations, text_of

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
FORM_DEPTH = 8

# Advance of a character in em, by kind.
EM_SPACE = 0.28
EM_NARROW, NARROW = 0.28, "ilIjtfr.,:;'!|"
EM_DASH, DASHES = 0.50, "_-"
EM_WIDE, WIDE = 0.86, "mwMW"
EM_UPPER = 0.70
EM_DIGIT = 0.56
EM_OTHER = 0.50
# Lightness from which paint is invisible, the widest line that counts as one,
# the slant a straight segment may have, and its least length.
LIGHT_RGB, LIGHT_CMYK = 0.94, 0.06
WIDEST_LINE = 5.0
SLANT, SHORTEST = 1.6, 6.0


class Run(NamedTuple):
    text: str
    x: float
    y: float
    w: float
    size: float
    up: float


class Seg(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float
    horiz: bool
    vert: bool


class Box(NamedTuple):
    llx: float
    lly: float
    urx: float
    ury: float


@dataclass
class Marks:
    rects: list[Box] = field(default_factory=list)
    segs: list[Seg] = field(default_factory=list)
    texts: list[Run] = field(default_factory=list)


def times(a: Matrix, b: Matrix) -> Matrix:
    """The matrix that applies a, then b."""
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def moved(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def number(v) -> float | None:
    """A numeric operand, rounded to single precision; None for anything else."""
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    try:
        return struct.unpack("f", struct.pack("f", v))[0]
    except OverflowError:
        return math.inf if v > 0 else -math.inf


def numbers(operands: list, n: int, at: int = 0) -> list[float] | None:
    """n numeric operands from place ``at`` on, or None where one is missing or no number."""
    out = [number(v) for v in operands[at : at + n]]
    return out if len(out) == n and None not in out else None


def em(c: str) -> float:
    if c in " \t":
        return EM_SPACE
    if c in NARROW:
        return EM_NARROW
    if c in DASHES:
        return EM_DASH
    if c in WIDE:
        return EM_WIDE
    if c.isupper():
        return EM_UPPER
    return EM_DIGIT if c in "0123456789" else EM_OTHER


class _Widths(dict):
    """Widths of characters in one text state, computed where first met."""

    def __init__(self, font_size: float, char_space: float, word_space: float, hscale: float):
        super().__init__()
        self.state = font_size, char_space, word_space, hscale

    def __missing__(self, c: str) -> float:
        font_size, char_space, word_space, hscale = self.state
        x = self[c] = (em(c) * font_size + char_space + (word_space if c == " " else 0.0)) * (hscale / 100.0)
        return x


_widths = lru_cache(maxsize=256)(_Widths)


@dataclass
class _State:
    ctm: Matrix
    fill_light: bool = False
    stroke_invisible: bool = False
    line_width: float = 1.0
    font_size: float = 12.0
    leading: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    hscale: float = 100.0


def _light_rgb(v: list) -> bool:
    n = numbers(v, 3)
    return n is not None and min(n) >= LIGHT_RGB


def _light_cmyk(v: list) -> bool:
    n = numbers(v, 4)
    return n is not None and max(n) <= LIGHT_CMYK


class _Machine:
    def __init__(self, doc: Document, ctm: Matrix, xobjects: dict[str, int], marks: Marks, depth: int, open_forms: set[int]):
        self.doc, self.xobjects, self.marks, self.depth, self.open_forms = doc, xobjects, marks, depth, open_forms
        self.state, self.stack = _State(ctm), []
        self.point = self.start = None
        self.rects: list[Box] = []
        self.segs: list[Seg] = []
        self.in_text = False
        self.text_matrix = self.line_matrix = UNIT

    def run(self, data: bytes) -> None:
        try:
            ops = operations(data)
        except PdfError:
            return
        for op, v in ops:
            if handler := _OPERATORS.get(op):
                handler(self, v)

    # state
    def push(self, v):
        self.stack.append(replace(self.state))

    def pop(self, v):
        if self.stack:
            self.state = self.stack.pop()

    def concat(self, v):
        if m := numbers(v, 6):
            self.state.ctm = times(tuple(m), self.state.ctm)

    def setter(name, value=lambda n: n, place=0):  # noqa: N805
        def put(self, v):
            if n := numbers(v, 1, place):
                setattr(self.state, name, value(n[0]))

        return put

    def flag(name, test):  # noqa: N805
        return lambda self, v: setattr(self.state, name, test(v))

    # paths
    def move(self, v):
        if p := numbers(v, 2):
            self.point = self.start = tuple(p)

    def line(self, v):
        if p := numbers(v, 2):
            self.line_to(*p)

    def line_to(self, x: float, y: float):
        if self.point is None:
            self.point = self.start = (x, y)
            return
        (ax, ay), (bx, by) = moved(self.state.ctm, *self.point), moved(self.state.ctm, x, y)
        dx, dy = abs(bx - ax), abs(by - ay)
        horiz, vert = dy <= SLANT and dx >= SHORTEST, dx <= SLANT and dy >= SHORTEST
        if horiz or vert:
            low, high = ((ay + by) * 0.5,) * 2 if horiz else (min(ay, by), max(ay, by))
            self.segs.append(Seg(min(ax, bx), low, max(ax, bx), high, horiz, vert))
        self.point = (x, y)

    def close(self, v=None):
        if self.point is not None and self.start is not None:
            self.line_to(*self.start)

    def curve(place):  # noqa: N805
        def put(self, v):
            if p := numbers(v, 2, place):
                self.point = tuple(p)

        return put

    def rectangle(self, v):
        if n := numbers(v, 4):
            x, y, w, h = n
            at = [moved(self.state.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
            box = Box(min(p[0] for p in at), min(p[1] for p in at), max(p[0] for p in at), max(p[1] for p in at))
            if math.isfinite(box.urx) and math.isfinite(box.ury):
                self.rects.append(box)
            self.point = self.start = (x, y)

    def clear(self, v=None):
        self.point = self.start = None
        self.rects, self.segs = [], []

    def painter(stroke, fill, close=False):  # noqa: N805
        def put(self, v):
            if close:
                self.close()
            stroked = stroke and not self.state.stroke_invisible and self.state.line_width <= WIDEST_LINE
            if stroked or (fill and self.state.fill_light):
                self.marks.rects += self.rects
                if stroked:
                    self.marks.segs += self.segs
            self.clear()

        return put

    # text
    def begin_text(self, v):
        self.in_text = True
        self.text_matrix = self.line_matrix = UNIT

    def end_text(self, v):
        self.in_text = False

    def set_matrix(self, v):
        if m := numbers(v, 6):
            self.text_matrix = self.line_matrix = tuple(m)

    def next_line(self, x: float, y: float):
        self.text_matrix = self.line_matrix = times((1, 0, 0, 1, x, y), self.line_matrix)

    def offset(self, v):
        if p := numbers(v, 2):
            self.next_line(*p)

    def offset_leading(self, v):
        if p := numbers(v, 2):
            self.state.leading = -p[1]
            self.next_line(*p)

    def new_line(self, v):
        self.next_line(0.0, -self.state.leading)

    def advance(self, x: float):
        self.text_matrix = times((1, 0, 0, 1, x, 0), self.text_matrix)

    def show(self, v):
        if self.in_text and v and isinstance(v[0], bytes):
            self.emit(v[0])

    def show_array(self, v):
        if self.in_text and v and isinstance(v[0], list):
            for x in v[0]:
                if isinstance(x, bytes):
                    self.emit(x)
                elif (n := number(x)) is not None:
                    self.advance(-n / 1000.0 * self.state.font_size * (self.state.hscale / 100.0))

    def line_show(self, v):
        if self.in_text:
            self.new_line(v)
            self.show(v)

    def spaced_line_show(self, v):
        if self.in_text:
            for name, n in zip(("word_space", "char_space"), map(number, v[:2])):
                if n is not None:
                    setattr(self.state, name, n)
            self.new_line(v)
            self.show(v[2:3])

    def width(self, text: str) -> float:
        s = self.state
        return sum(map(_widths(s.font_size, s.char_space, s.word_space, s.hscale).__getitem__, text))

    def emit(self, raw: bytes):
        """Runs of underscores and runs of anything else; only level text is kept, all of it advances."""
        text = text_of(raw)
        if not text:
            return
        placed = times(self.text_matrix, self.state.ctm)
        (x, y), (ux, uy) = moved(placed, 0, 0), moved(placed, 0, self.state.font_size)
        level = abs(ux - x) + 0.5 <= abs(uy - y)
        size, up = max(math.hypot(ux - x, uy - y), 1.0), uy - y
        for part in re.findall(r"_+|[^_]+", text):
            tx = self.width(part)
            if level:
                placed = times(self.text_matrix, self.state.ctm)
                (ax, ay), (bx, _) = moved(placed, 0, 0), moved(placed, tx, 0)
                self.marks.texts.append(Run(part, min(ax, bx), ay, abs(bx - ax), size, up))
            self.advance(tx)

    # form XObjects
    def draw(self, v):
        name = v[0] if v else None
        num = self.xobjects.get(name) if isinstance(name, Name) else None
        if num is None or self.depth >= FORM_DEPTH or num in self.open_forms:
            return
        source = form_source(self.doc, num, self.xobjects)
        if source:
            data, matrix, xobjects = source
            self.open_forms.add(num)
            _Machine(self.doc, times(matrix, self.state.ctm), xobjects, self.marks, self.depth + 1, self.open_forms).run(data)
            self.open_forms.discard(num)

    TABLE = {
        b"q": push, b"Q": pop, b"cm": concat, b"w": setter("line_width"),
        b"g": setter("fill_light", lambda n: n >= LIGHT_RGB), b"G": setter("stroke_invisible", lambda n: n >= LIGHT_RGB),
        b"rg": flag("fill_light", _light_rgb), b"RG": flag("stroke_invisible", _light_rgb),
        b"k": flag("fill_light", _light_cmyk), b"K": flag("stroke_invisible", _light_cmyk),
        b"m": move, b"l": line, b"h": close, b"re": rectangle, b"c": curve(4), b"v": curve(2), b"y": curve(2),
        b"S": painter(True, False), b"s": painter(True, False, True), b"f": painter(False, True), b"F": painter(False, True), b"f*": painter(False, True),
        b"B": painter(True, True), b"B*": painter(True, True), b"b": painter(True, True, True), b"b*": painter(True, True, True), b"n": clear,
        b"BT": begin_text, b"ET": end_text, b"Tm": set_matrix, b"Td": offset, b"TD": offset_leading, b"T*": new_line,
        b"TL": setter("leading"), b"Tc": setter("char_space"), b"Tw": setter("word_space"), b"Tz": setter("hscale"),
        b"Tf": setter("font_size", lambda n: max(abs(n), 0.1), 1), b"Tj": show, b"TJ": show_array, b"'": line_show, b'"': spaced_line_show, b"Do": draw,
    }


_OPERATORS = _Machine.TABLE


def _xobjects(doc: Document, resources) -> dict[str, int]:
    return {k: v.num for k, v in doc.dict_of(doc.dict_of(resources).get("XObject")).items() if isinstance(v, Ref)}


def form_source(doc: Document, num: int, parent: dict[str, int]) -> tuple[bytes, Matrix, dict[str, int]] | None:
    """Data, matrix and XObjects of a form; it sees its parent's XObjects only if it has no resources."""
    s = doc.objects.get(num)
    if not isinstance(s, Stream) or s.dict.get("Subtype") != "Form":
        return None
    try:
        data = doc.data(s) or s.data
    except PdfError:
        data = s.data
    m = doc.get(s.dict.get("Matrix"))
    m = numbers([doc.get(x) for x in m], 6) if isinstance(m, list) else None
    own = s.dict.get("Resources")
    return data, tuple(m) if m else UNIT, _xobjects(doc, own) if isinstance(own, (dict, Ref)) else parent


def page_marks(doc: Document, num: int) -> Marks:
    """The marks of a page. Parents' XObjects are seen where the page has none of the name."""
    xobjects: dict[str, int] = {}
    for d in reversed(doc.lineage(num)):
        xobjects |= _xobjects(doc, d.get("Resources"))
    marks = Marks()
    _Machine(doc, UNIT, xobjects, marks, 0, set()).run(doc.content(num))
    return marks


def box_of(doc: Document, v) -> Box | None:
    v = doc.get(v)
    n = numbers([doc.get(x) for x in v], 4) if isinstance(v, list) else None
    return Box(min(n[0], n[2]), min(n[1], n[3]), max(n[0], n[2]), max(n[1], n[3])) if n else None


def page_box(doc: Document, num: int) -> Box:
    """The nearest crop box up the page's line, else the nearest media box, else letter size."""
    line = doc.lineage(num)[:20]
    for key in ("CropBox", "MediaBox"):
        for d in line:
            if box := box_of(doc, d.get(key)):
                return box
    return Box(0.0, 0.0, 612.0, 792.0)
