"""Documents: parsing files into objects and pages, writing them, and synthesising test corpora."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.pdfsyntax import _OBJ, Encrypted, Invalid, Keyword, Name, PdfError, Reader, Ref, Stream, decoded, encoded

INHERIT = 20


@dataclass
class Document:
    """The objects of a file by number, with their generations, and its trailer."""

    objects: dict[int, object]
    trailer: dict
    gens: dict[int, int]

    def get(self, v, hops: int = 20):
        """v, or what it refers to."""
        while isinstance(v, Ref) and hops:
            v, hops = self.objects.get(v.num), hops - 1
        return None if isinstance(v, Ref) else v

    def dict_of(self, v) -> dict:
        v = self.get(v)
        return v.dict if isinstance(v, Stream) else v if isinstance(v, dict) else {}

    def data(self, s: Stream) -> bytes:
        """The decoded data of a stream, whose filters and parameters may be references."""
        keys = [k for k in ("Filter", "DecodeParms", "DP") if k in s.dict]
        return decoded(Stream(s.dict | {k: self.resolved(s.dict[k]) for k in keys}, s.data))

    def resolved(self, v, depth: int = 3):
        """v without references, as far as ``depth`` levels down."""
        v = self.get(v)
        if depth and isinstance(v, list):
            return [self.resolved(x, depth - 1) for x in v]
        return {k: self.resolved(x, depth - 1) for k, x in v.items()} if depth and isinstance(v, dict) else v

    def pages(self) -> list[int]:
        """Object numbers of the pages in order; a node met before is passed over."""
        out, seen = [], set()
        stack = [self.dict_of(self.trailer.get("Root")).get("Pages")]
        while stack:
            ref = stack.pop()
            if not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            node = self.dict_of(ref)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += reversed(kids)
            elif node.get("Type") == "Page" or "Contents" in node or "MediaBox" in node:
                out.append(ref.num)
        return out

    def lineage(self, num: int) -> list[dict]:
        """A page's dictionary and those of its parents, nearest first."""
        out, ref = [], Ref(num, 0)
        while isinstance(ref, Ref) and len(out) <= INHERIT:
            d = self.dict_of(ref)
            out.append(d)
            ref = d.get("Parent")
        return out

    def content(self, num: int) -> bytes:
        """The decoded content of a page; its parts are joined by line ends."""
        c = self.get(self.dict_of(Ref(num, 0)).get("Contents"))
        parts = [self.get(x) for x in c] if isinstance(c, list) else [c]
        out = []
        for s in parts:
            if isinstance(s, Stream):
                try:
                    out.append(self.data(s))
                except PdfError:
                    out.append(s.data)
        return b"\n".join(out)


def refs_of(v) -> list[int]:
    """Numbers of the objects that a value refers to, in order, repeats included."""
    out, stack = [], [v]
    while stack:
        x = stack.pop()
        if isinstance(x, Ref):
            out.append(x.num)
        elif isinstance(x, Stream):
            stack.append(x.dict)
        elif isinstance(x, dict):
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)
    return out


def _object_at(data: bytes, at: int, num: int | None, lengths) -> tuple[int, int, object]:
    m = _OBJ.match(data, Reader(data, at).at if data[at : at + 1].isdigit() else _skip(data, at))
    if not m or (num is not None and int(m[1]) != num):
        raise Invalid(f"no object {num} at {at}")
    r = Reader(data, m.end())
    v = r.value()
    if isinstance(v, Keyword):
        v = None
    if isinstance(v, dict):
        r.skip()
        if s := re.compile(rb"stream(\r\n|\n|\r)?").match(data, r.at):
            n = v.get("Length")
            n = lengths(n) if isinstance(n, Ref) else n
            begin = s.end()
            if not isinstance(n, int) or not re.compile(rb"[\s\x00]*endstream").match(data, begin + n):
                end = data.find(b"endstream", begin)
                if end < 0:
                    raise Invalid("stream without an end")
                n = len(re.sub(rb"\r?\n$|\r$", b"", data[begin:end]))
            v = Stream({k: x for k, x in v.items() if k != "Length"}, data[begin : begin + n])
    return int(m[1]), int(m[2]), v


def _skip(data: bytes, at: int) -> int:
    r = Reader(data, at)
    r.skip()
    return r.at


class _Loader:
    def __init__(self, data: bytes):
        self.data, self.offsets, self.packed, self.trailer = data, {}, {}, {}

    def length(self, ref: Ref):
        at = self.offsets.get(ref.num)
        try:
            return _object_at(self.data, at[0], ref.num, lambda _: None)[2] if at else None
        except PdfError:
            return None

    def sections(self) -> None:
        """All cross-reference sections from the last one back; earlier entries win."""
        starts = re.findall(rb"startxref\s+(\d+)", self.data[-2048:]) or re.findall(rb"startxref\s+(\d+)", self.data)
        if not starts:
            raise Invalid("no startxref")
        todo, seen = [int(starts[-1])], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            at = _skip(self.data, at)
            trailer = self._table(at + 4) if self.data.startswith(b"xref", at) else self._stream(at)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo += [v for k in ("Prev", "XRefStm") if isinstance(v := trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        r = Reader(self.data, at)
        while isinstance(first := r.value(), int):
            count = r.value()
            if not isinstance(count, int):
                raise Invalid("bad xref section")
            for num in range(first, first + count):
                off, gen, kind = r.value(), r.value(), r.value()
                if kind == b"n":
                    self.offsets.setdefault(num, (off, gen))
                elif kind == b"f":
                    self.offsets.setdefault(num, None)
                else:
                    raise Invalid("bad xref entry")
        trailer = r.value() if first == b"trailer" else None
        if not isinstance(trailer, dict):
            raise Invalid("no trailer")
        return trailer

    def _stream(self, at: int) -> dict:
        s = _object_at(self.data, at, None, self.length)[2]
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise Invalid("no cross-reference")
        w = s.dict.get("W", [])
        raw = decoded(s)
        if len(w) != 3 or not sum(w):
            raise Invalid("bad xref stream")
        index = s.dict.get("Index", [0, s.dict.get("Size", 0)])
        nums = [n for a, c in zip(index[::2], index[1::2], strict=True) for n in range(a, a + c)]
        for k, num in enumerate(nums):
            row = raw[k * sum(w) : (k + 1) * sum(w)]
            if len(row) < sum(w):
                break
            f = [int.from_bytes(row[sum(w[:i]) : sum(w[: i + 1])]) for i in range(3)]
            kind = f[0] if w[0] else 1
            if num not in self.offsets and num not in self.packed:
                if kind == 2:
                    self.packed[num] = (f[1], f[2])
                else:
                    self.offsets[num] = (f[1], f[2]) if kind == 1 else None
        return s.dict

    def scan(self) -> None:
        """Offsets by looking for objects, where the cross-reference is of no use."""
        self.offsets = {int(m[1]): (m.start(), int(m[2])) for m in _OBJ.finditer(self.data)}
        self.packed, self.trailer = {}, {}
        for m in re.finditer(rb"trailer", self.data):
            try:
                t = Reader(self.data, m.end()).value()
            except PdfError:
                continue
            if isinstance(t, dict):
                self.trailer |= t

    def objects(self, strict: bool) -> Document:
        objects, gens = {}, {}
        for num, at in self.offsets.items():
            if at is None or num == 0:
                continue
            try:
                objects[num] = _object_at(self.data, at[0], num, self.length)[2]
                gens[num] = at[1]
            except (PdfError, IndexError):
                if strict:
                    raise Invalid(f"object {num} can't be read") from None
        holders = {h for h, _ in self.packed.values()} | ({n for n, v in objects.items() if isinstance(v, Stream) and v.dict.get("Type") == "ObjStm"} if not strict else set())
        for holder in holders:
            s = objects.get(holder)
            if not isinstance(s, Stream):
                continue
            raw = decoded(s)
            first, n = s.dict.get("First", 0), s.dict.get("N", 0)
            r = Reader(raw)
            table = [(r.value(), r.value()) for _ in range(n)]
            for num, off in table:
                if num not in objects and (not strict or self.packed.get(num, (0,))[0] == holder):
                    objects[num], gens[num] = Reader(raw, first + off).value(), 0
        objects = {n: v for n, v in objects.items() if not (isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm"))}
        return Document(objects, self.trailer, gens)


def load(data: bytes) -> Document:
    """A document from its bytes. Encrypted ones raise Encrypted, unreadable ones Invalid."""
    if b"%PDF-" not in data[:1024]:
        raise Invalid("no PDF header")
    loader = _Loader(data)
    try:
        loader.sections()
        if "Encrypt" in loader.trailer:
            raise Encrypted("document is encrypted")
        doc = loader.objects(True)
        if not doc.dict_of(doc.trailer.get("Root")):
            raise Invalid("no catalog")
    except Encrypted:
        raise
    except (PdfError, TypeError, ValueError, IndexError, KeyError):
        loader.scan()
        if "Encrypt" in loader.trailer:
            raise Encrypted("document is encrypted") from None
        try:
            doc = loader.objects(False)
        except (TypeError, ValueError, IndexError, KeyError) as e:
            raise Invalid(str(e)) from None
        if "Root" not in doc.trailer:
            roots = [n for n, v in doc.objects.items() if isinstance(v, dict) and v.get("Type") == "Catalog"]
            if roots:
                doc.trailer["Root"] = Ref(roots[-1], doc.gens.get(roots[-1], 0))
    if not doc.dict_of(doc.trailer.get("Root")):
        raise Invalid("no catalog")
    return doc


def _renumbered(v, to: dict[int, int]):
    if isinstance(v, Ref):
        return Ref(to[v.num], 0) if v.num in to else None
    if isinstance(v, Stream):
        return Stream(_renumbered(v.dict, to), v.data)
    if isinstance(v, dict):
        return {k: _renumbered(x, to) for k, x in v.items()}
    return [_renumbered(x, to) for x in v] if isinstance(v, list) else v


def dump(doc: Document) -> bytes:
    """The bytes of a document: objects renumbered from 1, and a classic cross-reference table."""
    to = {n: k for k, n in enumerate(sorted(doc.objects), 1)}
    out, at, size = [b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"], [], 15
    for num in sorted(doc.objects):
        part = b"%d 0 obj\n" % to[num] + encoded(_renumbered(doc.objects[num], to)) + b"\nendobj\n"
        at.append(size)
        out.append(part)
        size += len(part)
    trailer = {k: _renumbered(doc.trailer[k], to) for k in ("Root", "Info", "ID") if k in doc.trailer}
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(to) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at))
    out.append(b"trailer\n" + encoded({"Size": len(to) + 1, **trailer}) + b"\nstartxref\n%d\n%%%%EOF\n" % size)
    return b"".join(out)


def build(pages: list[bytes], box: tuple[float, float] = (612, 792), extra: list | None = None, images: list[list[Stream]] | None = None) -> bytes:
    """A file of one page a content stream; ``extra`` are objects that nothing refers to, ``images``
    the image streams of each page, as Im1, Im2, ..."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 3: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}
    kids, num = [], 4
    for k, content in enumerate(pages):
        xobjects = {}
        for i, image in enumerate(images[k] if images else [], 1):
            objects[num] = image
            xobjects[f"Im{i}"] = Ref(num, 0)
            num += 1
        objects[num] = Stream({}, content)
        resources = {"Font": {"F1": Ref(3, 0)}} | ({"XObject": xobjects} if xobjects else {})
        objects[num + 1] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, *box], "Resources": resources, "Contents": Ref(num, 0)}
        kids.append(Ref(num + 1, 0))
        num += 2
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    for x in extra or []:
        objects[num] = x
        num += 1
    return dump(Document(objects, {"Root": Ref(1, 0)}, dict.fromkeys(objects, 0)))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def output_path(column: str, suffix: str) -> F.Column:
    """A path with its last extension replaced by ``suffix``."""
    return F.concat(F.regexp_replace(F.col(column), r"\.[^./]*$", ""), F.lit("." + suffix))
