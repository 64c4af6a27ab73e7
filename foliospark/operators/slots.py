"""Fillable slots of a page, their labels and their names.

Candidates come in a fixed order (underscore runs, rectangles, lines) and one that overlaps an
accepted one is out, so this is a fold over a page's marks, not a join. The label searches are
arg-mins over the text runs; ``labels.nearest_label`` says the same over tables.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from foliospark.operators.marks import Box, Marks, Run

TEXT, CHECKBOX = "text", "checkbox"


@dataclass
class Slot:
    page_no: int
    kind: str
    rect: Box
    name: str


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def shared_length(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def area(r: Box) -> float:
    return abs((r.urx - r.llx) * (r.ury - r.lly))


def overlaps(a: Box, b: Box) -> bool:
    shared = shared_length(a.llx, a.urx, b.llx, b.urx) * shared_length(a.lly, a.ury, b.lly, b.ury)
    return shared / max(min(area(a), area(b)), 1.0) > 0.4


def fitted(r: Box, page: Box, least_width: float) -> Box | None:
    """r cut to the page; None if too little is left."""
    out = Box(max(r.llx, page.llx), max(r.lly, page.lly), min(r.urx, page.urx), min(r.ury, page.ury))
    return out if out.urx - out.llx >= least_width and out.ury - out.lly >= 6.0 else None


def holds(page: Box, r: Box) -> bool:
    x, y = (r.llx + r.urx) / 2, (r.lly + r.ury) / 2
    return page.llx - 4 <= x <= page.urx + 4 and page.lly - 4 <= y <= page.ury + 4


def classify(r: Box, page: Box) -> str | None:
    w, h = r.urx - r.llx, r.ury - r.lly
    frame = max(abs(r.llx - page.llx), abs(r.lly - page.lly), abs(page.urx - r.urx), abs(page.ury - r.ury)) < 8.0
    if w < 6.0 or h < 6.0 or w * h > area(page) * 0.45 or frame:
        return None
    if w <= 24.0 and h <= 24.0 and 0.7 <= w / h <= 1.45:
        return CHECKBOX
    return TEXT if w >= 36.0 and 10.0 <= h <= 220.0 and w <= (page.urx - page.llx) * 0.95 else None


# labels


def is_underscores(text: str) -> bool:
    t = text.strip()
    return len(t) >= 3 and set(t) == {"_"}


def is_label(run: Run) -> bool:
    return bool(run.text.strip()) and not is_underscores(run.text)


def sanitize(raw: str) -> str | None:
    """A label as a field name, or None where it can't be one."""
    t = re.sub(r"^[-*•·\s]+", "", raw.strip())
    t = re.sub(r"[:.* \t]+$", "", t).strip()
    if not any(map(str.isalnum, t)) or len(t.split()) > 8 or len(t) > 48:
        return None
    t = "".join(c for c in t if unicodedata.category(c) != "Cc").replace(".", "_")
    return " ".join(t.split()) or None


def cluster(texts: list[Run], seed: int) -> str:
    """The text of the line around a run: runs join while their gap to any member is small."""
    high = max(texts[seed].size * 0.45, 3.5)
    free = [k for k, r in enumerate(texts) if k != seed and is_label(r) and abs(r.y - texts[seed].y) <= high]
    members, todo = [seed], [seed]
    while todo:
        o = texts[todo.pop()]
        near = []
        for k in free:
            r = texts[k]
            gap = r.x - (o.x + o.w) if r.x >= o.x else o.x - (r.x + r.w)
            if -1.5 <= gap < 16.0:
                near.append(k)
        free = [k for k in free if k not in near]
        members += near
        todo += near
    out, right = "", None
    # equal left edges keep the order of joining: the seed, then emission order
    for k in sorted(members[:1] + sorted(members[1:]), key=lambda k: texts[k].x):
        r = texts[k]
        if right is not None and r.x - right > 1.4 and not out.endswith(" ") and not r.text.startswith(" "):
            out += " "
        out += r.text
        right = r.x + r.w
    return out


def nearest(texts: list[Run], distance: Callable[[Run], float | None]) -> str | None:
    """The sanitised cluster around the label of least distance, the first on ties."""
    best, at = math.inf, -1
    for k, r in enumerate(texts):
        if is_label(r) and (d := distance(r)) is not None and d < best:
            best, at = d, k
    return sanitize(cluster(texts, at)) if at >= 0 else None


def label_left(texts: list[Run], llx: float, y: float) -> str | None:
    def distance(r: Run) -> float | None:
        gap = llx - (r.x + r.w)
        return gap if -4.0 <= gap <= 80.0 and -4.0 <= r.y - y <= r.size * 0.9 + 2.0 else None

    return nearest(texts, distance)


def label_beside(texts: list[Run], r: Box, right: bool) -> str | None:
    middle, high = (r.lly + r.ury) * 0.5, (r.ury - r.lly) * 0.7

    def distance(t: Run) -> float | None:
        gap = t.x - r.urx if right else r.llx - (t.x + t.w)
        level = abs(t.y + math.copysign(1.0, t.up) * t.size * 0.3 - middle) <= max(t.size * 0.85, high)
        return gap if level and -6.0 <= gap <= 90.0 else None

    return nearest(texts, distance)


def label_above(texts: list[Run], r: Box) -> str | None:
    def distance(t: Run) -> float | None:
        dy = t.y - r.ury
        close = shared_length(t.x, t.x + t.w, r.llx, r.urx) >= 8.0 or abs(t.x - r.llx) < 48.0
        return dy if close and -2.0 <= dy <= 36.0 else None

    return nearest(texts, distance)


def label_above_line(texts: list[Run], x0: float, x1: float, y: float) -> str | None:
    def distance(t: Run) -> float | None:
        dy = t.y - y
        close = shared_length(t.x, t.x + t.w, x0, x1) >= 10.0 or abs(t.x - x0) <= 40.0
        return dy if close and 1.0 <= dy <= 32.0 else None

    return nearest(texts, distance)


# candidates

Line = tuple[float, float, float]  # x0, x1, y


def underscore_box(r: Run) -> Box:
    h = clamp(r.size, 8.0, 18.0)
    below, above = (0.25, 0.95) if r.up >= 0.0 else (0.95, 0.25)
    return Box(r.x, r.y - h * below, r.x + r.w, r.y + h * above)


def grid_boxes(marks: Marks) -> list[Box]:
    """Cells between two level segments and upright ones that cover most of their distance."""
    level, upright, out = [s for s in marks.segs if s.horiz], [s for s in marks.segs if s.vert], []
    for i, a in enumerate(level):
        for b in level[i + 1 :]:
            low, high = min(a.y0, b.y0), max(a.y0, b.y0)
            left, right = max(a.x0, b.x0) - 3.0, min(a.x1, b.x1) + 3.0
            if not 6.0 <= high - low <= 220.0 or right - left < 8.0:
                continue
            xs = sorted(x for v in upright if left <= (x := (v.x0 + v.x1) * 0.5) <= right and shared_length(v.y0, v.y1, low, high) >= (high - low) * 0.7)
            edges: list[float] = []
            for x in xs:
                if not edges or abs(x - edges[-1]) >= 2.5:
                    edges.append(x)
            out += [Box(p, low, q, high) for p, q in zip(edges, edges[1:]) if len(xs) >= 2 and 6.0 <= q - p <= 500.0]
    return out


def merged_lines(lines: Iterable[Line]) -> list[Line]:
    """Lines by height, then left end; each is merged into the one before if they lie on each other."""
    out: list[Line] = []
    for x0, x1, y in sorted(lines, key=lambda t: (t[2], t[0])):
        if out:
            p0, p1, py = out[-1]
            shorter = min(p1 - p0, x1 - x0)
            if abs(py - y) < 2.0 and shorter > 0.0 and shared_length(p0, p1, x0, x1) / shorter > 0.8:
                out[-1] = (min(p0, x0), max(p1, x1), py)
                continue
        out.append((x0, x1, y))
    return out


def distinct_boxes(boxes: Iterable[Box]) -> list[Box]:
    """Boxes in order, less those that overlap one kept before."""
    out: list[Box] = []
    for b in boxes:
        if not any(overlaps(b, o) for o in out):
            out.append(b)
    return out


def has_text(texts: list[Run], r: Box) -> bool:
    for t in texts:
        x, y = t.x + t.w * 0.5, t.y + math.copysign(1.0, t.up) * t.size * 0.35
        if is_label(t) and r.llx + 1.5 < x < r.urx - 1.5 and r.lly + 1.5 < y < r.ury - 1.5:
            return True
    return False


def underlines_text(texts: list[Run], x0: float, x1: float, y: float) -> bool:
    """Whether a line only stresses text that stands on it."""
    for t in texts:
        shared = shared_length(t.x, t.x + t.w, x0, x1)
        if t.w >= 8.0 and -2.0 <= t.y - y <= t.size * 1.15 and shared >= t.w * 0.55 and shared >= (x1 - x0) * 0.55 and x1 - x0 <= t.w * 1.4 + 6.0:
            return True
    return False


def on_edge(x0: float, x1: float, y: float, blocked: list[Box]) -> bool:
    return any(shared_length(x0, x1, b.llx, b.urx) / max(x1 - x0, 1.0) >= 0.65 and min(abs(y - b.lly), abs(y - b.ury)) < 3.0 for b in blocked)


def line_height(texts: list[Run], x0: float, y: float) -> float:
    return clamp(next((t.size for t in texts if abs(t.y - y) < 28.0 and t.x <= x0 + 8.0), 12.0), 10.0, 16.0)


def propose(marks: Marks, page: Box, page_no: int, occupied: list[Box]) -> list[Slot]:
    """The slots of a page in the order of acceptance. A name is empty where no label is found."""
    texts, blocked, out = marks.texts, list(occupied), []

    def accept(kind: str, rect: Box, name: str | None) -> None:
        blocked.append(rect)
        out.append(Slot(page_no, kind, rect, name or ""))

    def free(rect: Box | None, inside: bool) -> bool:
        return rect is not None and (not inside or holds(page, rect)) and not any(overlaps(rect, b) for b in blocked)

    boxes = [*marks.rects, *grid_boxes(marks)]
    flat = [b for b in boxes if 0.3 <= b.ury - b.lly <= 7.0 and b.urx - b.llx >= 36.0]
    lines = [(s.x0, s.x1, (s.y0 + s.y1) * 0.5) for s in marks.segs if s.horiz and s.x1 - s.x0 >= 8.0]
    lines += [(b.llx, b.urx, (b.lly + b.ury) * 0.5) for b in flat]

    for r in texts:
        if is_underscores(r.text) and r.w >= 18.0 and free(rect := fitted(underscore_box(r), page, 8.0), True):
            accept(TEXT, rect, label_left(texts, rect.llx, r.y))

    for b in distinct_boxes(b for b in boxes if b not in flat):
        kind = classify(b, page)
        if kind is None or has_text(texts, b) or not free(rect := fitted(b, page, 6.0 if kind == CHECKBOX else 8.0), False):
            continue
        right, left, above = (lambda r=rect: label_beside(texts, r, True)), (lambda r=rect: label_beside(texts, r, False)), (lambda r=rect: label_above(texts, r))
        tried = (right, left, above) if kind == CHECKBOX else (left, above, right)
        accept(kind, rect, next((n for f in tried if (n := f())), None))

    for x0, x1, y in merged_lines(lines):
        length = x1 - x0
        if length < 28.0 or underlines_text(texts, x0, x1, y) or on_edge(x0, x1, y, blocked):
            continue
        name = label_left(texts, x0, y) or label_above_line(texts, x0, x1, y)
        if not name and (length < 48.0 or length > (page.urx - page.llx) * 0.85 or not page.lly + 40.0 <= y <= page.ury - 40.0):
            continue
        rect = fitted(Box(x0, y - 1.5, x1, y - 1.5 + line_height(texts, x0, y)), page, 8.0)
        if free(rect, True):
            accept(TEXT, rect, name)
    return out


def ordered(slots: list[Slot]) -> list[Slot]:
    """Slots from the top of a page down, then left to right."""
    return sorted(slots, key=lambda s: (-s.rect.ury, s.rect.llx))


def named(slots: list[Slot], existing: Iterable[str]) -> list[Slot]:
    """Slots in order with names that are unique in the document."""
    used, counts = set(existing), {TEXT: 0, CHECKBOX: 0}
    out = []
    for s in slots:
        name, n = s.name, 1
        if not name:
            while not name or name in used:
                counts[s.kind] += 1
                name = f"{'Text' if s.kind == TEXT else 'Check'}{counts[s.kind]}"
        while name in used:
            n += 1
            name = f"{s.name}_{n}"
        used.add(name)
        out.append(Slot(s.page_no, s.kind, s.rect, name))
    return out
