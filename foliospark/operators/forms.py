"""Form fields of a document: those it has, and adding new ones."""

from __future__ import annotations

from foliospark.operators.marks import Box, box_of
from foliospark.operators.slots import TEXT, Slot, clamp
from foliospark.sources.pdf import Document
from foliospark.sources.pdfsyntax import Name, Ref, Stream, bytes_of, text_of

NAME_DEPTH = 16


def occupied(doc: Document, page: int) -> list[Box]:
    """Rectangles of a page's annotations, whatever their kind; those written into the list itself don't count."""
    annots = doc.get(doc.dict_of(Ref(page, 0)).get("Annots"))
    refs = [a for a in annots if isinstance(a, Ref)] if isinstance(annots, list) else []
    return [b for a in refs if (b := box_of(doc, doc.dict_of(a).get("Rect")))]


def existing_names(doc: Document) -> set[str]:
    """Partial names of all fields down from the catalog's form."""
    out: set[str] = set()
    todo = [(doc.dict_of(doc.trailer.get("Root")).get("AcroForm"), 0)]
    while todo:
        v, depth = todo.pop()
        if depth > NAME_DEPTH:
            continue
        if isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
        elif d := doc.dict_of(v):
            if isinstance(t := d.get("T"), bytes) and t:
                out.add(text_of(t))
            todo += [(d[k], depth + 1) for k in ("Kids", "Fields") if k in d]
    return out - {""}


def _appearance(w: float, h: float, checked: bool) -> Stream:
    tick = [(0.20 * w, 0.52 * h), (0.42 * w, 0.18 * h), (0.82 * w, 0.78 * h)]
    body = f"{clamp(min(w, h) * 0.12, 0.8, 2.2):.2f} w 1 J 1 j " + " ".join(f"{x:.2f} {y:.2f} {op}" for (x, y), op in zip(tick, "mll", strict=True)) + " S"
    return Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0.0, 0.0, w, h], "FormType": 1, "Resources": {}}, body.encode() if checked else b"")


def _widget(doc: Document, slot: Slot, page: int) -> int:
    w, h = slot.rect.urx - slot.rect.llx, slot.rect.ury - slot.rect.lly
    d = {"Type": Name("Annot"), "Subtype": Name("Widget"), "T": bytes_of(slot.name), "Rect": [float(x) for x in slot.rect], "F": 4, "P": Ref(page, 0)}
    if slot.kind == TEXT:
        d |= {"FT": Name("Tx"), "DA": bytes_of(f"/Helv {clamp(h * 0.62, 8.0, 12.0):.1f} Tf 0 g"), "Q": 0, "BS": {"W": 0, "S": Name("S")}}
        if h >= 36.0:
            d["Ff"] = 4096
    else:
        states = {k: Ref(_added(doc, _appearance(w, h, k == "Yes")), 0) for k in ("Yes", "Off")}
        d |= {"FT": Name("Btn"), "V": Name("Off"), "AS": Name("Off"), "AP": {"N": states}, "Ff": 0}
    return _added(doc, d)


def _added(doc: Document, v) -> int:
    num = max(doc.objects, default=0) + 1
    doc.objects[num] = v
    return num


def _owned(doc: Document, v) -> dict:
    """A dictionary that can be changed in place: the object referred to, or v itself."""
    d = doc.get(v)
    return d if isinstance(d, dict) else {}


def add_fields(doc: Document, slots: list[Slot]) -> None:
    """Puts a widget on each slot, in page order, and the form's entries into the catalog."""
    pages = doc.pages()
    fields = []
    for s in slots:
        page = pages[s.page_no - 1]
        fields.append(Ref(_widget(doc, s, page), 0))
        d = doc.dict_of(Ref(page, 0))
        annots = doc.get(d.get("Annots"))
        d["Annots"] = [*(annots if isinstance(annots, list) else []), fields[-1]]
    root = doc.dict_of(doc.trailer.get("Root"))
    form = _owned(doc, root.get("AcroForm"))
    if not form:
        form = {}
        root["AcroForm"] = Ref(_added(doc, form), 0)
    old = doc.get(form.get("Fields"))
    form["Fields"] = [*(old if isinstance(old, list) else []), *fields]
    form["NeedAppearances"] = True
    resources = dict(_owned(doc, form.get("DR")))
    fonts = dict(_owned(doc, resources.get("Font")))
    if "Helv" not in fonts:
        fonts["Helv"] = Ref(_added(doc, {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}), 0)
    form["DR"] = resources | {"Font": fonts}
    form.setdefault("DA", b"/Helv 10 Tf 0 g")
