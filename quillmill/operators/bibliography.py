"""Scan for the reference list from a document's end: the last heading that a list follows, over windows of lines.

A page is never gathered with others: one ordered window a document counts, for every line, the entries below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions.text import col

#: Headings of reference lists (fixed values).
HEADINGS = ("references", "bibliography", "works cited", "literature cited", "literatur", "literaturverzeichnis", "références", "bibliographie", "referencias", "bibliografía", "referências", "список литературы", "литература", "参考文献")
#: So many entries must follow a heading.
LEAST = 3


def is_list_heading(c: Column | str) -> Column:
    """A line that is nothing but a list's heading, with or without number."""
    return F.lower(col(c)).rlike(rf"^\s*(?:[0-9]+\.?\s+)?(?:{'|'.join(HEADINGS)})\s*:?\s*$")


def entry_label(c: Column | str) -> Column:
    """Printed number of a line that opens an entry; null for others."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(?:\[([0-9]{1,4})\]|([0-9]{1,4})\.\s)", 0), F.lit(""))


def opens_entry(c: Column | str) -> Column:
    """A numbered entry, or a name with a year on the same line."""
    return entry_label(c).isNotNull() | (col(c).rlike(r"^\s*\p{Lu}[\p{L}'’-]+,?\s") & I.has_reference_evidence(c) & (F.length(col(c)) >= 30))


def scan_backward(pages: DataFrame, floor: int = 1, doc: str = "doc_hash", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, line_no, entries, plausible, complete, pages_read)`` of every document with pages at or above ``floor``.

    The heading nearest to the end that at least ``LEAST`` entries follow; without one, page and line are null and all
    pages were read. ``pages_read`` counts from the last page to the heading's. Null texts are pages without lines.
    """
    kept = pages.filter(F.col(page) >= floor)
    lines = kept.select(doc, page, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(doc).orderBy(F.desc(page), F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    label = F.regexp_extract(entry_label("line"), "[0-9]+", 0).try_cast("int")
    years = F.size(I.all_years("line"))
    below = lines.select(
        doc, page, "line_no", is_list_heading("line").alias("heading"), F.coalesce(F.sum(opens_entry("line").cast("int")).over(w), F.lit(0)).alias("entries"),
        F.coalesce(F.max(label).over(w), F.lit(0)).alias("top"), F.coalesce(F.sum(years).over(w), F.lit(0)).alias("years"),
    )
    found = below.filter(F.col("heading") & (F.col("entries") >= LEAST)).groupBy(doc).agg(F.max_by(F.struct("line_no", "entries", "top", "years"), F.struct(page, "line_no")).alias("f"), F.max(page).alias("found_page"))
    counts = kept.groupBy(doc).agg(F.count_distinct(page).alias("n_pages"), F.count_distinct(page).alias("all_pages"), F.max(page).alias("last_page"))
    plausible = (F.col("f.top") <= F.col("f.entries") + 1) & (F.col("f.years") <= F.col("f.entries") * 1.5 + 3)
    return counts.join(found, doc, "left").select(
        doc, F.col("found_page").alias("page"), F.col("f.line_no").alias("line_no"), F.coalesce("f.entries", F.lit(0)).alias("entries"), F.coalesce(plausible, F.lit(False)).alias("plausible"), F.col("found_page").isNotNull().alias("complete"),
        F.coalesce(F.col("last_page") - F.col("found_page") + 1, F.col("n_pages")).alias("pages_read"),
    )


def scan_quality(scan: str = "") -> Column:
    """What scans are compared by: complete, then plausible, then entries."""
    p = f"{scan}." if scan else ""
    return F.struct(F.col(f"{p}complete").alias("complete"), F.col(f"{p}plausible").alias("plausible"), F.col(f"{p}entries").alias("entries"))


def keep_better(scans: list[tuple[str, DataFrame]], doc: str = "doc_hash") -> DataFrame:
    """``(doc, route, tried, page, line_no, entries, plausible, complete, pages_read)``: the best scan of each document, the earlier of equals, with the routes tried."""
    out = None
    for i, (name, s) in enumerate(scans):
        x = s.withColumn("route", F.lit(name)).withColumn("at", F.lit(i))
        out = x if out is None else out.unionByName(x)
    rest = [c for c in out.columns if c not in (doc, "at")]
    best = out.groupBy(doc).agg(F.max_by(F.struct(*rest), F.struct(scan_quality().alias("q"), (-F.col("at")).alias("first"))).alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "route"))), lambda t: t["route"]), ">").alias("tried"))
    return best.select(doc, "tried", *[F.col(f"b.{c}").alias(c) for c in rest])


def scan_auto(first: DataFrame, second: DataFrame, window: int = 20, doc: str = "doc_hash", page: str = "page", text: str = "text") -> DataFrame:
    """Routed scan: the first extractor's pages; the second's where that is not complete and plausible, over its last ``window`` pages at most."""
    a = scan_backward(first, 1, doc, page, text)
    doubtful = a.filter(~(F.col("complete") & F.col("plausible"))).select(doc)
    last = second.groupBy(doc).agg((F.max(page) - window + 1).alias("floor"))
    again = second.join(doubtful, doc, "left_semi").join(last, doc).filter(F.col(page) >= F.col("floor")).drop("floor")
    return keep_better([("first", a), ("second", scan_backward(again, 1, doc, page, text))], doc)
