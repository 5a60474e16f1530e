"""Regions of a page: captions, figures, tables, code, footnotes, mathematics.

Rules on single lines are Catalyst expressions; walks from a caption up or down the page run a page at a time.
``lines``: (doc_hash, page, line_idx, text, x0, y0, x1, y1, size, role).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X

#: Lines of a region, lines of a caption, captions of a page, share of a line inside a box, size of a footnote and its band.
LEAST, MOST, CAPTION, CAPTIONS, INSIDE, SMALL, FOOT = 2, 40, 14, 64, 0.7, 0.92, 0.35
MONOSPACE = r"(?i)mono|courier|typewriter|cmtt|consol|menlo|inconsolata|lucida console|fixed|ttf?[0-9]"


def is_monospace_font(c: Column | str) -> Column:
    return X.col(c).rlike(MONOSPACE)


def overlap_share(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of box a that lies in box b."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def lines_in_figures(lines: DataFrame, figures: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx, role)`` of body lines inside a figure box; the page is the equality key of the join."""
    f = figures.select(doc, "page", F.col("idx").alias("fig"), F.col("kind").alias("fig_kind"), *(F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1")))
    x = lines.filter("role = 'body'").join(f, [doc, "page"])
    share = overlap_share({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"f_{c}") for c in ("x0", "y0", "x1", "y1")})
    return x.filter(share >= INSIDE).groupBy(doc, "page", "line_idx").agg(F.min_by("fig_kind", "fig").alias("role"))


def fragment_like(n: Column, fragments: Column) -> Column:
    """2 to 40 lines, six in ten fragments."""
    return n.between(LEAST, MOST) & (fragments * 10 >= n * 6)


def table_like(n: Column, short: Column) -> Column:
    """2 to 40 lines, half of them short or with two numbers."""
    return n.between(LEAST, MOST) & (short * 2 >= n)


def algorithm_like(n: Column, marked: Column) -> Column:
    """1 to 40 lines, three in ten with a pseudo-code mark."""
    return n.between(1, MOST) & (marked * 10 >= n * 3)


def line_flags(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines with the flags that region rules count."""
    n, words = X.numeric_share(text)
    return lines.withColumns({"fragment": X.is_fragment(text), "prose": X.is_prose_like(text), "algorithm": X.is_algorithm_line(text), "math": X.is_math_line(text), "table_row": (words <= 5) | (n >= 2), "caption": X.caption_kind(text)})


_CAPTION = re.compile(r"^\s*(?:(Fig(?:ure|\.)?|FIG(?:URE|\.)?)|(Tab(?:le|\.)?|TAB(?:LE|\.)?)|(Algorithm|ALGORITHM))\s*(?:\d+(?:\.\d+)*|[IVXL]+|[A-Z]\.?\d+)\s*[.:|–—-]")


def _kind(text: str) -> str | None:
    m = _CAPTION.match(text)
    return None if not m else "figure" if m[1] else "table" if m[2] else "algorithm"


def _prose(text: str) -> bool:
    ws = text.split()
    numbers = sum(bool(re.fullmatch(r"[-+−±(]?\d[\d.,]*[)%]?", w)) for w in ws)
    return len(ws) >= 7 and numbers * 10 <= len(ws) * 3 and sum(bool(re.match(r"[^\W\d_A-ZÀ-Þ]", w)) for w in ws) >= 2


def _fragment(text: str) -> bool:
    ws = text.split()
    numbers = sum(bool(re.fullmatch(r"[-+−±(]?\d[\d.,]*[)%]?", w)) for w in ws)
    return len(ws) <= 4 or (numbers >= 1 and len(ws) - numbers <= 1) or numbers * 10 >= len(ws) * 6


def _pseudo(text: str) -> bool:
    return bool(re.search(r"←|:=|▷", text) or re.match(r"\s*(?:\d+\s*[:.]?\s*)?(?:if\b.*\bthen|else\b|end\b|for\b.*\bdo|while\b.*\bdo|repeat\b|until\b|return\b|require|ensure|input:|output:|procedure\b|function\b)", text, re.I))


def tag_page(rows: list[dict]) -> list[str]:
    """Roles of one page's lines in reading order: captions with their regions, then mathematics; only body lines change."""
    roles = [r["role"] for r in rows]
    texts = [r["text"] or "" for r in rows]
    captions = [(i, k) for i, t in enumerate(texts) if roles[i] == "body" and (k := _kind(t))]
    if len(captions) > CAPTIONS:
        return roles
    height = float(np.median([r["y1"] - r["y0"] for r in rows])) if rows else 1.0

    def gap(a: int, b: int) -> float:
        return min(abs(rows[a]["y0"] - rows[b]["y1"]), abs(rows[b]["y0"] - rows[a]["y1"]))

    ends = {}
    for i, _ in captions:
        roles[i] = "caption"
        j = i
        while j + 1 < len(rows) and j + 1 - i < CAPTION and roles[j + 1] == "body" and gap(j, j + 1) < 0.8 * height and not re.search(r"[.?!]\s*$", texts[j]) and not _kind(texts[j + 1]):
            j += 1
            roles[j] = "caption"
        ends[i] = j

    def walk(start: int, step: int) -> list[int]:
        out, prose = [], 0
        j = start
        while 0 <= j < len(rows) and len(out) < MOST and roles[j] == "body":
            if _prose(texts[j]):
                prose += 1
                if prose == 2 or not out:
                    break
            else:
                prose = 0
            out.append(j)
            j += step
        while out and _prose(texts[out[-1]]):
            out.pop()
        return out

    for i, kind in captions:
        above, below = walk(i - 1, -1), walk(ends[i] + 1, 1)

        def good(region: list[int], kind: str = kind) -> bool:
            n = len(region)
            if kind == "figure":
                return LEAST <= n <= MOST and sum(_fragment(texts[j]) for j in region) * 10 >= n * 6
            if kind == "table":
                return LEAST <= n <= MOST and sum(len(texts[j].split()) <= 5 or len(re.findall(r"\d[\d.,]*", texts[j])) >= 2 for j in region) * 2 >= n
            return 1 <= n <= MOST and sum(_pseudo(texts[j]) for j in region) * 10 >= n * 3

        order = [above, below] if kind == "figure" else [below, above] if kind == "table" else [below]
        region = next((r for r in order if good(r)), [])
        for j in region:
            roles[j] = kind
    return roles


def tag_regions(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx, role)`` of every line; a page is the group."""
    kinds = dict(lines.dtypes)

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("line_idx")
        roles = tag_page(d[["text", "x0", "y0", "x1", "y1", "role"]].to_dict("records"))
        return pd.DataFrame({doc: key[0], "page": key[1], "line_idx": d["line_idx"], "role": roles})

    return lines.groupBy(doc, "page").applyInPandas(run, f"{doc} {kinds[doc]}, page {kinds['page']}, line_idx int, role string")


def footnotes(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)`` of small lines at the foot of a page from the first marker down.

    ``lines`` also has page_height and body_size. A page's lines are one bounded window.
    """
    w = Window.partitionBy(doc, "page").orderBy(F.desc("line_idx"))
    small = (F.col("size") <= F.col("body_size") * SMALL) & (F.col("y1") <= F.col("page_height") * FOOT)
    x = lines.withColumn("breaks", F.sum((~small).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("breaks = 0")
    marker = F.col("text").rlike(r"^\s*(?:[*†‡§¶]|[⁰¹²³⁴⁵⁶⁷⁸⁹]+|[0-9]{1,2}[\s.])")
    up = Window.partitionBy(doc, "page").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("open", F.max(marker.cast("int")).over(up)).filter("open = 1").select(doc, "page", "line_idx")


def column_starts(lines: DataFrame, tolerance: float = 3.0, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, starts)``: left edges shared by two lines or more, a few points apart counting as one."""
    w = Window.partitionBy(doc, "page").orderBy("x0")
    x = lines.select(doc, "page", "x0").withColumn("new", (F.col("x0") - F.coalesce(F.lag("x0").over(w), F.lit(-1e9)) > tolerance).cast("int"))
    x = x.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = x.groupBy(doc, "page", "cluster").agg(F.count("*").alias("n"), F.min("x0").alias("x")).filter("n >= 2")
    return c.groupBy(doc, "page").agg(F.array_sort(F.collect_list("x")).alias("starts"))
