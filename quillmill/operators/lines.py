"""Lines and reading order of positioned text, page by page.

``spans`` rows (doc_hash, page, span_idx, text, x0, y0, x1, y1, font, size, seq; origin bottom left) become lines in
reading order. A page is the group: it is bounded by what fits on one page.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed values, in font sizes: tolerance of the baseline, reach along a line, gap that makes a space.
BASELINE, REACH, SPACE = 0.4, 1.0, 0.15
#: Gaps between blocks in line heights, column gap in character widths and in page widths, split of fused rows.
ROW_GAP, COLUMN_GAP, COLUMN_PAGE, PARAGRAPH = 1.0, 2.0, 0.005, 1.5
DEPTH = 64


@dataclass
class Box:
    x0: float
    y0: float
    x1: float
    y1: float

    def union(self, o: Box) -> Box:
        return Box(min(self.x0, o.x0), min(self.y0, o.y0), max(self.x1, o.x1), max(self.y1, o.y1))


@dataclass
class Line:
    box: Box
    size: float
    spans: list[int] = field(default_factory=list)
    text: str = ""
    column: int = 0


def group_lines(spans: list[dict]) -> list[Line]:
    """Spans on one baseline within reach of each other become a line; an index by baseline keeps the search short."""
    order = sorted((i for i, s in enumerate(spans) if s["text"].strip()), key=lambda i: (-spans[i]["y0"], spans[i]["x0"], spans[i]["seq"]))
    lines: list[Line] = []
    rows: dict[int, list[int]] = {}
    for i in order:
        s = spans[i]
        size = s["size"] or 10.0
        cell = int(s["y0"] // 4)
        best = None
        for c in range(cell - 1 - int(size * BASELINE // 4), cell + 2 + int(size * BASELINE // 4)):
            for k in rows.get(c, ()):
                ln = lines[k]
                tall = max(size, ln.size)
                if abs(ln.box.y0 - s["y0"]) <= BASELINE * tall and s["x0"] - ln.box.x1 <= REACH * tall and ln.box.x0 - s["x1"] <= REACH * tall:
                    best = k if best is None else max(best, k)
        if best is None:
            lines.append(Line(Box(s["x0"], s["y0"], s["x1"], s["y1"]), size, [i]))
            rows.setdefault(cell, []).append(len(lines) - 1)
        else:
            ln = lines[best]
            ln.box, ln.size = ln.box.union(Box(s["x0"], s["y0"], s["x1"], s["y1"])), max(ln.size, size)
            ln.spans.append(i)
    for ln in lines:
        finish_line(ln, spans)
    return [ln for ln in lines if ln.text]


def finish_line(line: Line, spans: list[dict]) -> None:
    """Text of a line from left to right: a space at each gap, accents put on the letter before them."""
    line.spans.sort(key=lambda i: (spans[i]["x0"], spans[i]["seq"]))
    text, end = "", None
    for i in line.spans:
        s = spans[i]
        t = s["text"]
        if end is not None and s["x0"] - end > SPACE * (s["size"] or 10.0) and not text[-1:].isspace() and not t[:1].isspace():
            text += " "
        if t and unicodedata.combining(t[0]):
            text = text.rstrip()
        text += t
        end = s["x1"]
    line.text = unicodedata.normalize("NFC", text).strip()


def _row_gaps(boxes: list[Box], by_top: list[int]) -> list[tuple[float, int]]:
    """(gap, position) between what lies above and below, positions counted from the top."""
    out, low = [], boxes[by_top[0]].y0
    for k in range(1, len(by_top)):
        b = boxes[by_top[k]]
        out.append((low - b.y1, k))
        low = min(low, b.y0)
    return out


def _column_gaps(boxes: list[Box], by_left: list[int]) -> list[tuple[float, int]]:
    out, right = [], boxes[by_left[0]].x1
    for k in range(1, len(by_left)):
        b = boxes[by_left[k]]
        out.append((b.x0 - right, k))
        right = max(right, b.x1)
    return out


def _coexist(boxes: list[Box], left: list[int], right: list[int]) -> bool:
    """Two sides stand beside each other: half of the shorter overlaps, with two line centres of each inside."""
    span = lambda ix: (min(boxes[i].y0 for i in ix), max(boxes[i].y1 for i in ix))
    (a0, a1), (b0, b1) = span(left), span(right)
    lo, hi = max(a0, b0), min(a1, b1)
    if hi - lo < 0.5 * min(a1 - a0, b1 - b0):
        return False
    inside = lambda ix: sum(lo <= (boxes[i].y0 + boxes[i].y1) / 2 <= hi for i in ix)
    return inside(left) >= 2 and inside(right) >= 2


def order_lines(lines: list[Line], page_width: float) -> list[Line]:
    """Recursive cuts: columns that stand side by side, bands between bridging lines, the widest row gap, the widest column gap."""
    if not lines:
        return []
    boxes = [ln.box for ln in lines]
    height = float(np.median([b.y1 - b.y0 for b in boxes])) or 1.0
    chars = [(b.x1 - b.x0) / max(1, len(ln.text)) for b, ln in zip(boxes, lines, strict=True)]
    row_gap, col_gap = ROW_GAP * height, max(COLUMN_GAP * float(np.median(chars)), COLUMN_PAGE * page_width)
    out: list[int] = []
    leaf = 0

    def run(idx: list[int], depth: int) -> None:
        nonlocal leaf
        by_top = sorted(idx, key=lambda i: (-boxes[i].y1, boxes[i].x0))
        by_left = sorted(idx, key=lambda i: (boxes[i].x0, -boxes[i].y1))
        if len(idx) > 1 and depth < DEPTH:
            columns = [(g, k) for g, k in _column_gaps(boxes, by_left) if g >= col_gap]
            if columns:
                _, k = max(columns)
                left, right = by_left[:k], by_left[k:]
                if _coexist(boxes, left, right):
                    run(left, depth + 1)
                    run(right, depth + 1)
                    return
            x0, x1 = min(boxes[i].x0 for i in idx), max(boxes[i].x1 for i in idx)
            # Wide lines bridge the gutter: what is between two of them is a band of its own.
            bridges = [i for i in by_top if boxes[i].x1 - boxes[i].x0 > 0.6 * (x1 - x0)]
            if bridges and len(bridges) < len(idx):
                bands: list[list[int]] = [[]]
                wide: list[bool] = [False]
                for i in by_top:
                    w = i in bridges
                    if w != wide[-1] and bands[-1]:
                        bands.append([])
                        wide.append(w)
                    wide[-1] = w
                    bands[-1].append(i)
                if len(bands) > 1:
                    for band in bands:
                        run(band, depth + 1)
                    return
            rows = [(g, k) for g, k in _row_gaps(boxes, by_top) if g >= row_gap]
            if rows:
                _, k = max(rows, key=lambda r: (r[0], -r[1]))
                run(by_top[:k], depth + 1)
                run(by_top[k:], depth + 1)
                return
            if columns:
                _, k = max(columns)
                run(by_left[:k], depth + 1)
                run(by_left[k:], depth + 1)
                return
        for i in by_top:
            lines[i].column = leaf
            out.append(i)
        leaf += 1

    run(list(range(len(lines))), 0)
    return [lines[i] for i in out]


def separators(lines: list[Line]) -> list[str]:
    """What stands before each line in the page text."""
    height = float(np.median([ln.box.y1 - ln.box.y0 for ln in lines])) if lines else 1.0
    out = []
    for k, ln in enumerate(lines):
        if k == 0:
            out.append("")
        else:
            p = lines[k - 1]
            out.append("\n\n" if p.column != ln.column or p.box.y0 - ln.box.y1 > PARAGRAPH * height else "\n")
    return out


def order_page(spans: list[dict], width: float) -> list[Line]:
    """Lines of one page in reading order."""
    return order_lines(group_lines(spans), width)


LINE_COLUMNS = "line_idx int, text string, x0 double, y0 double, x1 double, y1 double, size double, column int, separator string, spans array<int>"


def page_lines(spans: DataFrame, width: float = 612.0, doc: str = "doc_hash", page: str = "page") -> DataFrame:
    """``(doc, page, line_idx, text, box, size, column, separator, spans)`` of every page with text."""
    kinds = dict(spans.dtypes)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("span_idx")
        records = d[["text", "x0", "y0", "x1", "y1", "size", "seq", "span_idx"]].to_dict("records")
        records = [r for r in records if isinstance(r["text"], str)]
        lines = order_page(records, width)
        seps = separators(lines)
        rows = [(*key, i, ln.text, ln.box.x0, ln.box.y0, ln.box.x1, ln.box.y1, ln.size, ln.column, seps[i], [int(records[s]["span_idx"]) for s in ln.spans]) for i, ln in enumerate(lines)]
        return pd.DataFrame(rows, columns=[doc, page, *(c.split()[0] for c in LINE_COLUMNS.split(", "))])

    return spans.groupBy(doc, page).applyInPandas(run, f"{doc} {kinds[doc]}, {page} {kinds[page]}, {LINE_COLUMNS}")
