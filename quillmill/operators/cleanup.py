"""Clean-up of extracted lines: furniture, line-end hyphens, roles. Set-based where the rule is; a document at a time where lines depend on those before.

``lines`` rows: (doc_hash, page, line_idx, text, y0, y1, page_height).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.session import batch_udf

#: Share of the page that is the inner and the outer edge band.
INNER, OUTER = 0.08, 0.15
STAMP = r"^(?i)\s*arXiv:\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?\s+\[[^\]]+\]\s+[0-9]{1,2}\s+\p{L}{3}\s+[0-9]{4}"
#: Prefixes that stay hyphenated, and prefixes that never stand alone.
COMPOUND_PREFIXES = ("self", "non", "well", "cross", "high", "low", "all")
BOUND_PREFIXES = ("re", "un", "pre", "dis", "mis", "sub", "inter", "trans", "multi", "micro", "bio", "geo", "hyper", "anti", "de", "co", "con", "in", "im", "ex", "per", "pro", "com")


def page_furniture(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)`` of running heads, page numbers and margin stamps.

    A head's digit-masked text stands on two pages inside the inner band, or is strongly repeated inside the outer
    one: on three odd or three even pages, or on three pages that are two fifths of the document.
    """
    near = F.least(F.col("y0") / F.col("page_height"), 1 - F.col("y1") / F.col("page_height"))
    x = lines.select(doc, "page", "line_idx", "text", X.digit_key("text").alias("key"), near.alias("near")).filter(F.col("near") <= OUTER)
    heads = x.filter(F.col("key").rlike(r"\p{L}"))
    by_key = heads.groupBy(doc, "key").agg(
        F.count_distinct(F.when(F.col("near") <= INNER, F.col("page"))).alias("inner"), F.count_distinct("page").alias("seen"),
        F.count_distinct(F.when(F.col("page") % 2 == 1, F.col("page"))).alias("odd"), F.count_distinct(F.when(F.col("page") % 2 == 0, F.col("page"))).alias("even"),
    )
    total = lines.groupBy(doc).agg(F.count_distinct("page").alias("pages"))
    strong = (F.col("odd") >= 3) | (F.col("even") >= 3) | ((F.col("seen") >= 3) & (F.col("seen") * 5 >= F.col("pages") * 2))
    flagged = by_key.join(total, doc).select(doc, "key", (F.col("inner") >= 2).alias("twice"), strong.alias("strong"))
    running = heads.join(flagged, [doc, "key"]).filter((F.col("twice") & (F.col("near") <= INNER)) | F.col("strong")).select(doc, "page", "line_idx")
    numbers = x.filter((F.col("near") <= INNER) & X.is_page_number("text")).select(doc, "page", "line_idx")
    stamps = lines.filter((F.col("page") == 1) & F.col("text").rlike(STAMP)).select(doc, "page", "line_idx")
    return running.unionByName(numbers).unionByName(stamps).distinct()


def vocabulary(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, word, n)``: words and hyphenated pairs of a document, the halves at line-end hyphens left out."""
    w = Window.partitionBy(doc).orderBy("page", "line_idx")
    x = lines.select(doc, "text", F.lag("text").over(w).alias("before"))
    body = F.regexp_replace("text", r"\p{L}+-\s*$", "")
    body = F.when(F.col("before").rlike(r"\p{L}-\s*$"), F.regexp_replace(body, r"^\s*\p{L}+", "")).otherwise(body)
    pairs = F.regexp_extract_all(F.lower(body), F.lit(r"\p{L}+(?:-\p{L}+)+|\p{L}+"), F.lit(0))
    return x.select(doc, F.explode(pairs).alias("word")).groupBy(doc, "word").agg(F.count("*").alias("n"))


def hyphen_policy(left: str, right: str, count) -> str:
    """join or keep, by the first rule that applies; ``count`` gives a lower-case word's count in the document."""
    lo, ro = left.lower(), right.lower()
    pair, joined = count(f"{lo}-{ro}"), count(lo + ro)
    known = lambda w: count(w) > 0
    if pair > 0 and pair >= joined:
        return "keep"
    if left[:1].isupper() and lo in COMPOUND_PREFIXES and right.islower() and known(ro) and joined < 2 * max(pair, 1):
        return "keep"
    if joined > 0:
        return "join"
    if lo in COMPOUND_PREFIXES:
        return "keep"
    if lo in BOUND_PREFIXES and right.islower() and (known(ro) or len(right) >= 5):
        return "join"
    if left.isupper() and right.isupper() and len(right) >= 3 and len(left + right) >= 6 and not (known(lo) and known(ro)):
        return "join"
    if right[:1].isupper() and not left.isupper():
        return "keep"
    if len(left) >= 3 and len(right) >= 3 and known(lo) and known(ro):
        return "keep"
    return "join"


def join_hyphens(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """Lines with the continued word moved up to the line that broke it; a document is one group, in page order."""
    kind = dict(lines.dtypes)[doc]
    import re

    broken, starts = re.compile(r"([^\W\d_]+)-\s*$"), re.compile(r"^\s*([^\W\d_]+)")

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["page", "line_idx"])
        texts = [t if isinstance(t, str) else "" for t in d["text"]]
        counts: dict[str, int] = {}
        skip = False
        for t in texts:
            ws = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t.lower())
            if skip and ws:
                ws = ws[1:]
            skip = bool(broken.search(t))
            if skip and ws:
                ws = ws[:-1]
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
        for i in range(len(texts) - 1):
            a, b = broken.search(texts[i]), starts.search(texts[i + 1])
            if not a or not b:
                continue
            left, right = a[1], b[1]
            if not (right[:1].islower() or (left.isupper() and right.isupper() and len(left) >= 2 and len(right) >= 2)):
                continue
            mark = "-" if hyphen_policy(left, right, lambda w: counts.get(w, 0)) == "keep" else ""
            texts[i] = texts[i][: a.start()] + left + mark + right
            texts[i + 1] = texts[i + 1][b.end() :].lstrip()
        return pd.DataFrame({doc: d[doc], "page": d["page"], "line_idx": d["line_idx"], "text": texts})

    return lines.select(doc, "page", "line_idx", "text").groupBy(doc).applyInPandas(run, f"{doc} {kind}, page int, line_idx int, text string")


def line_role(text: Column | str) -> Column:
    """Role of a line by its text alone: toc, caption, heading, math or body."""
    t = F.trim(X.col(text))
    heading = t.rlike(r"^(?i)(?:abstract|introduction|references|bibliography|acknowledge?ments?|conclusions?|appendix)\W*$") | (t.rlike(r"^(?:[0-9]+(?:\.[0-9]+)*|[IVX]+\.)\s+\p{Lu}") & (F.size(X.tokens(t)) <= 12) & ~t.rlike(r"[.,;]$"))
    return F.when(X.is_toc(t), "toc").when(X.caption_kind(t).isNotNull(), "caption").when(heading, "heading").when(X.is_math_line(t), "math").otherwise("body")


def role_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.select(line_role(text).alias("role")).groupBy("role").agg(F.count("*").alias("n"))


def rebuild(lines: DataFrame, furniture: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, text)`` from the surviving lines in order."""
    kept = lines.join(furniture, [doc, "page", "line_idx"], "left_anti")
    return kept.groupBy(doc, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda x: x["text"]), "\n").alias("text"))


def code_runs(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)`` of runs of at least three lines flagged ``mono``: islands by a running count of changes."""
    w = Window.partitionBy(doc, "page").orderBy("line_idx")
    x = lines.withColumn("change", (F.col("mono") != F.coalesce(F.lag("mono").over(w), ~F.col("mono"))).cast("int"))
    x = x.withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("n", F.count("*").over(Window.partitionBy(doc, "page", "run")))
    return x.filter(F.col("mono") & (F.col("n") >= 3)).select(doc, "page", "line_idx")


@batch_udf("string")
def fold_lines(texts: pd.Series) -> pd.Series:
    """Line ends of any kind as LF."""
    return texts.str.replace("\r\n", "\n", regex=False).str.replace("\r", "\n", regex=False)


def merge_scripts(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx, base_idx, text)``: raised or lowered fragments with the base line they belong to and their script form.

    ``lines``: (doc, page, line_idx, text, x0, y0, x1, y1, size). A fragment is shorter than five characters, smaller
    than its base and overlaps its band; the nearest base to the left wins, then the lower index. The page is the
    equality key of the join.
    """
    b = lines.select(doc, "page", F.col("line_idx").alias("base_idx"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1", "size")))
    x = lines.filter(F.length(F.trim("text")).between(1, 4)).join(b, [doc, "page"])
    inside = (F.col("line_idx") != F.col("base_idx")) & (F.col("size") < F.col("b_size") * 0.85) & (F.col("y0") < F.col("b_y1")) & (F.col("y1") > F.col("b_y0"))
    gap = F.least(F.abs(F.col("x0") - F.col("b_x1")), F.when(F.col("x0").between(F.col("b_x0"), F.col("b_x1")), F.lit(0.0)))
    middle = (F.col("y0") + F.col("y1")) / 2
    raised = middle > (F.col("b_y0") + F.col("b_y1")) / 2
    form = F.when(raised, X.script_form("text", True)).otherwise(X.script_form("text", False))
    x = x.filter(inside).withColumn("gap", gap).filter(F.col("gap") <= F.col("b_size")).withColumn("form", form).filter("form IS NOT NULL")
    return x.groupBy(doc, "page", "line_idx").agg(F.min_by("base_idx", F.struct("gap", "base_idx")).alias("base_idx"), F.min_by("form", F.struct("gap", "base_idx")).alias("text"))


def front_matter(lines: DataFrame, doc: str = "doc_hash", first: int = 60) -> DataFrame:
    """``(doc, line_idx)`` of the lines of page 1 before the abstract or introduction, up to the first run of three prose lines."""
    w = Window.partitionBy(doc).orderBy("line_idx")
    x = lines.filter("page = 1").select(doc, "line_idx", "text", F.col("text").rlike(r"^(?i)\s*(?:abstract\b|(?:1\.?\s+)?introduction\s*$)").alias("stop"), X.is_prose_like("text").alias("prose"))
    run3 = F.col("prose") & F.coalesce(F.lead("prose", 1).over(w), F.lit(False)) & F.coalesce(F.lead("prose", 2).over(w), F.lit(False))
    x = x.withColumn("n", F.row_number().over(w)).withColumn("ends", (F.col("stop") & (F.col("n") <= first)) | run3)
    x = x.withColumn("over", F.max(F.col("ends").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    has = Window.partitionBy(doc)
    return x.withColumn("any", F.max((F.col("stop") & (F.col("n") <= first)).cast("int")).over(has)).filter("any = 1 AND over = 0").select(doc, "line_idx")


def is_title_page(pages: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc)`` whose first page is short and has no abstract or introduction line, while the second has an abstract line."""
    abstract, intro = F.col("text").rlike(r"(?im)^\s*abstract\b"), F.col("text").rlike(r"(?im)^\s*(?:1\.?\s+)?introduction\s*$")
    p = pages.filter("page <= 2").select(doc, "page", F.size(X.tokens("text")).alias("n"), abstract.alias("a"), intro.alias("i"))
    return p.groupBy(doc).agg(F.max(F.when(F.col("page") == 1, (F.col("n") < 300) & ~F.col("a") & ~F.col("i"))).alias("first"), F.max(F.when(F.col("page") == 2, F.col("a"))).alias("second")).filter("first AND second").select(doc)


def ruled_footnotes(lines: DataFrame, rules: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)`` of small lines under a short rule at the foot of a page.

    ``lines``: with size, body_size, page_width, page_height; ``rules``: (doc, page, x0, y0, x1, y1).
    """
    r = rules.select(doc, "page", F.col("x0").alias("rx0"), F.col("x1").alias("rx1"), F.col("y0").alias("ry0"), F.col("y1").alias("ry1"))
    x = lines.join(r, [doc, "page"]).filter((F.col("ry1") - F.col("ry0") < 3) & (F.col("rx1") - F.col("rx0")).between(30, F.col("page_width") * 0.6) & (F.col("ry0") <= F.col("page_height") * 0.35) & (F.col("y1") <= F.col("ry0")) & (F.col("x0") < F.col("rx1") + 200) & (F.col("x1") > F.col("rx0")))
    by = x.groupBy(doc, "page", "rx0", "ry0").agg(F.count("*").alias("n"), F.min((F.col("size") <= F.col("body_size") * 0.92).cast("int")).alias("small"), F.min(F.col("ry0") - F.col("y1")).alias("gap"))
    good = by.filter("n <= 15 AND small = 1 AND gap <= 24").select(doc, "page", "rx0", "ry0")
    return x.join(good, [doc, "page", "rx0", "ry0"]).select(doc, "page", "line_idx").distinct()


def continued_footnotes(notes: DataFrame, lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)``: the small run at the foot of a page whose predecessor ends inside a footnote.

    ``notes``: footnote lines; ``lines``: with text, size, body_size, y1, page_height.
    """
    w = Window.partitionBy(doc, "page").orderBy(F.desc("line_idx"))
    last = lines.withColumn("k", F.row_number().over(w)).filter("k = 1").join(notes, [doc, "page", "line_idx"], "left_semi")
    opened = last.filter(~X.ends_sentence("text")).select(doc, (F.col("page") + 1).cast("int").alias("page"))
    small = (F.col("size") <= F.col("body_size") * 0.92) & (F.col("y1") <= F.col("page_height") * 0.35)
    x = lines.join(opened, [doc, "page"], "left_semi").withColumn("breaks", F.sum((~small).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.filter("breaks = 0").select(doc, "page", "line_idx").join(notes, [doc, "page", "line_idx"], "left_anti")


def biographies(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, line_idx)`` of author biographies after the reference list: from a line that opens with a name and a fixed phrase to the end."""
    from quillmill.operators.citations import HEADING

    w = Window.partitionBy(doc).orderBy("page", "line_idx").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("text").rlike(r"^\s*(?:\p{Lu}[\p{L}.'’-]+\s+){1,4}(?:\([^)]*\)\s+)?(?:received|is (?:currently|a|an|the)|was born|obtained|joined)\b")
    x = lines.withColumn("after", F.max(F.col("text").rlike(HEADING).cast("int")).over(w)).withColumn("bio", F.max((opens & (F.col("after") == 1)).cast("int")).over(w))
    return x.filter("bio = 1").select(doc, "page", "line_idx")


def body_font_size(spans: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, body_size)``: the median size of a document's spans."""
    return spans.filter("size > 0").groupBy(doc).agg(F.median("size").alias("body_size"))
