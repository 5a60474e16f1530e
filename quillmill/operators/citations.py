"""Reference lists and citation markers of paged text.

``lines``: (doc_hash, page, line_idx, text). A document's list is one group, since whether a line starts an entry
depends on the number that is expected; everything after that is row-local or joined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.session import batch_udf

HEADING = r"^(?i)\s*(?:[0-9IVX]+\.?\s+)?(?:references|bibliography|literature cited|works cited|literatur|références|bibliographie|referencias|список литературы|参考文献)\s*:?\s*$"
#: Widest expanded range, lines looked at after a heading, lines in which a headless list must go on.
SPAN, AFTER, HEADLESS = 50, 3, 12
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
LABEL = re.compile(r"^\s*(?:\[(\d{1,4})\]|(\d{1,4})\.(?=\s)|\((\d{1,4})\)|(\d{1,4})(?=\s+[^\W\d_]))\s*")


def entry_evidence(c: Column | str) -> Column:
    """A line that looks like the start of an entry: a label, or a name with an initial, or a year."""
    t = X.col(c)
    return t.rlike(r"^\s*(?:\[[^\]]{1,12}\]|\([0-9]{1,3}\)|[0-9]{1,3}\.?\s)") | t.rlike(r"^\s*\p{Lu}[\p{L}'’-]+,?\s+\p{Lu}\.") | t.rlike(r"\((?:19|20)[0-9]{2}[a-z]?\)")


def reference_sections(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, section, page, line_idx)`` of headings that an entry follows within three lines; else the last heading; else a headless [1]."""
    w = Window.partitionBy(doc).orderBy("page", "line_idx")
    x = lines.filter(F.trim("text") != "").select(doc, "page", "line_idx", F.col("text").rlike(HEADING).alias("head"), entry_evidence("text").alias("ev"), F.regexp_extract("text", r"^\s*\[([0-9]{1,4})\]", 1).alias("n"))
    x = x.withColumn("follows", F.max((F.col("ev") & ~F.col("head")).cast("int")).over(w.rowsBetween(1, AFTER)) == 1)
    ahead = w.rowsBetween(1, HEADLESS)
    x = x.withColumn("headless", (F.col("n") == "1") & F.array_contains(F.collect_list("n").over(ahead), "2") & F.array_contains(F.collect_list("n").over(ahead), "3"))
    place = F.struct("page", "line_idx")
    best = x.groupBy(doc).agg(
        F.array_sort(F.collect_list(F.when(F.col("head") & F.col("follows"), place))).alias("good"), F.max(F.when(F.col("head"), place)).alias("last"), F.max(F.when(F.col("headless"), place)).alias("bare"),
    )
    chosen = F.when(F.size("good") > 0, F.col("good")).when(F.col("last").isNotNull(), F.array("last")).when(F.col("bare").isNotNull(), F.array("bare"))
    return best.select(doc, F.posexplode(chosen).alias("section", "at")).select(doc, "section", "at.page", "at.line_idx")


def segment(texts: list[str]) -> list[tuple[str | None, str]]:
    """(label, raw) of the entries in a list's lines.

    Numbered lists: the expected number starts an entry, a restart at 1 ends the list. Others: a line that opens with
    a name and initial starts one. Entries without a year or identifier join the one before; a trailing run is dropped.
    """
    first = [m for t in texts[:3] if (m := LABEL.match(t))]
    entries: list[list] = []
    if first:
        expected = None
        for t in texts:
            m = LABEL.match(t)
            number = int(next(g for g in m.groups() if g)) if m else None
            if number is not None and (expected is None or number == expected):
                entries.append([m[0].strip(), t[m.end() :].strip()])
                expected = number + 1
            elif number == 1 and expected is not None and expected > 3:
                break
            elif entries:
                entries[-1][1] = append(entries[-1][1], t)
    else:
        opens = re.compile(r"^\s*(?:(?:van|von|de|del|der|la|le|al|ten)\s+)*[^\W\d_a-zà-öø-ÿ][\w'’-]+,?\s+(?:[^\W\d_a-zà-öø-ÿ]\.|et al)|^\s*(?:[^\W\d_a-zà-öø-ÿ]\.\s*)+[^\W\d_]{2,}")
        for t in texts:
            if opens.match(t) or not entries:
                entries.append([None, t.strip()])
            else:
                entries[-1][1] = append(entries[-1][1], t)
    evidence = re.compile(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)|\bn\.\s?d\.|in press|10\.\d{4,9}/|\barxiv\b|https?://", re.I)
    out: list[tuple[str | None, str]] = []
    for label, raw in entries:
        if evidence.search(raw) or not out:
            out.append((label, raw))
        elif not first:
            out[-1] = (out[-1][0], append(out[-1][1], raw))
        else:
            out.append((label, raw))
    while out and not evidence.search(out[-1][1]):
        out.pop()
    return out


def append(raw: str, more: str) -> str:
    """A continuation line joined on, a broken word mended."""
    more = more.strip()
    if re.search(r"[^\W\d_]-$", raw) and more[:1].islower():
        return raw[:-1] + more
    return f"{raw} {more}".strip()


def reference_entries(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, idx, label, raw, page)`` of all lists of a document, counted on over its lists."""
    sections = reference_sections(lines, doc)
    kind = dict(lines.dtypes)[doc]

    def run(key, d: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        rows, idx = [], 0
        if len(s):
            d = d.sort_values(["page", "line_idx"])
            place = list(zip(d["page"], d["line_idx"], strict=True))
            heads = sorted(zip(s["page"], s["line_idx"], strict=True))
            for k, at in enumerate(heads):
                lo = place.index(at)
                hi = place.index(heads[k + 1]) if k + 1 < len(heads) else len(place)
                texts = [t for t in d["text"].iloc[lo:hi] if isinstance(t, str) and t.strip()]
                if re.match(HEADING.replace("^(?i)", "(?i)^"), texts[0]):
                    texts = texts[1:]
                for label, raw in segment(texts):
                    rows.append((key[0], idx, label, raw, int(at[0])))
                    idx += 1
        return pd.DataFrame(rows, columns=[doc, "idx", "label", "raw", "page"])

    return lines.select(doc, "page", "line_idx", "text").groupBy(doc).cogroup(sections.groupBy(doc)).applyInPandas(run, f"{doc} {kind}, idx int, label string, raw string, page int")


_ABBREVIATIONS = frozenset("vol no pp ed eds et al fig eq sec dr prof st proc conf int j ann arch rev lett trans acad sci univ vs cf ca".split())


def title_end(text: str) -> int:
    """End of the title that opens a text: the first stop that ends a sentence, not an abbreviation."""
    for m in re.finditer(r"[.?!](?=\s|$)", text):
        word = re.search(r"([^\W\d_]+)$", text[: m.start()])
        rest = text[m.end() :].lstrip()
        if m[0] == "." and word and (len(word[1]) == 1 or word[1].lower() in _ABBREVIATIONS) and rest:
            continue
        if rest[:1].islower():
            continue
        return m.end() if m[0] != "." else m.start()
    return len(text)


def find_quoted(text: str) -> str | None:
    """The first quoted title of some length."""
    m = re.search(r"[“\"«]([^”\"»]{8,}?)[,.]?[”\"»]", text)
    return m[1].strip(" ,.") if m else None


def split_authors(segment_: str) -> list[str]:
    """Names of an author list in the usual orders; ``et al.`` is dropped."""
    t = re.sub(r"\bet\s+al\.?", "", segment_)
    t = re.sub(r"\s*(?:&|\band\b|\bund\b|\bet\b|\by\b)\s*", "; ", t)
    if ";" in t:
        parts = [p for p in t.split(";")]
    else:
        initials_first = re.match(r"\s*(?:[^\W\d_]\.[\s-]*)+[^\W\d_]{2}", t)
        parts = t.split(",") if initials_first else re.findall(r"[^,]+,\s*(?:[^\W\d_]\.[\s-]*)+|[^,]+", t)
    out = []
    for p in parts:
        p = p.strip(" ,.;:") + ("." if re.search(r"\b[^\W\d_]\.?$", p.strip(" ,;:")) else "")
        if re.search(r"[^\W\d_]{2}", p) and not re.search(r"\d", p):
            out.append(p)
    return out


def entry_fields(raw: str) -> dict:
    """Title and authors of an entry, null rather than guessed."""
    body = re.sub(r"^\s*(?:\[[^\]]{1,12}\]|\(\d{1,4}\)|\d{1,4}\.(?=\s))\s*", "", raw)
    masked = re.sub(r"(?:doi\s*:?\s*)?10\.\d{4,9}/\S+|https?://\S+|arxiv:\s*\S+", " ", body, flags=re.I)
    quoted = find_quoted(masked)
    if quoted:
        head = masked[: masked.find(quoted)].rstrip(" “\"«,")
        return {"title": quoted[:500], "authors": split_authors(head)}
    year = re.search(r"\((?:1[5-9]|20)\d\d[a-z]?\)\s*[.,:]?\s*", masked)
    if year and year.start() > 3:
        rest = masked[year.end() :]
        return {"title": rest[: title_end(rest)].strip(" .,") [:500] or None, "authors": split_authors(masked[: year.start()])}
    colon = re.match(r"((?:[^:;]+;\s*)*[^:;]{3,80}):\s+", masked)
    if colon and re.search(r"[^\W\d_]\.", colon[1]):
        rest = masked[colon.end() :]
        return {"title": rest[: title_end(rest)].strip(" .,")[:500] or None, "authors": split_authors(colon[1])}
    end = title_end(masked)
    head, rest = masked[:end], masked[end:].lstrip(" .")
    if re.search(r"\b[^\W\d_]\.|\b[^\W\d_]{1,3}(?:,|$)", head) and rest:
        return {"title": rest[: title_end(rest)].strip(" .,")[:500] or None, "authors": split_authors(head)}
    return {"title": None, "authors": []}


@batch_udf("struct<title:string,authors:array<string>>")
def parse_title_authors(raw: pd.Series) -> pd.DataFrame:
    """Title and authors of raw entries; null text has neither."""
    got = [entry_fields(r) if isinstance(r, str) else {"title": None, "authors": []} for r in raw]
    return pd.DataFrame({"title": [g["title"] for g in got], "authors": [g["authors"] for g in got]})


def parse_entries(entries: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries with doi, arxiv_id, url, year, volume, issue, pages from Catalyst and title, authors from one Arrow call."""
    body = F.regexp_replace(I.strip_label(raw), rf"(?i)(?:doi\s*:?\s*)?{I.DOI}|https?://\S+", " ")
    n = I.parse_numbers(body)
    out = entries.withColumns({"doi": F.lower(I.find_doi(raw)), "arxiv_id": I.find_arxiv(raw), "url": I.find_url(raw), "year": I.find_year(body), "__n": n, "__t": parse_title_authors(F.col(raw))})
    return out.withColumns({"volume": F.col("__n.volume"), "issue": F.col("__n.issue"), "pages": F.col("__n.pages"), "title": F.col("__t.title"), "authors": F.col("__t.authors")}).drop("__n", "__t")


def cited_numbers(inner: Column, largest: Column) -> Column:
    """Numbers of a group such as ``1, 3–5``; null if one is 0, reversed, too wide a range or above the largest."""
    parts = F.filter(F.split(F.regexp_replace(inner, r"\s", ""), "[,;]"), lambda p: p != "")
    lo = lambda p: F.regexp_extract(p, r"^([0-9]{1,4})", 1).try_cast("int")
    hi = lambda p: F.coalesce(F.regexp_extract(p, r"[-–—]([0-9]{1,4})$", 1).try_cast("int"), lo(p))
    fine = F.forall(parts, lambda p: p.rlike(r"^[0-9]{1,4}(?:[-–—][0-9]{1,4})?$") & (lo(p) >= 1) & (hi(p) >= lo(p)) & (hi(p) - lo(p) <= SPAN) & (hi(p) <= largest))
    numbers = F.flatten(F.transform(parts, lambda p: F.sequence(lo(p), F.greatest(hi(p), lo(p)))))
    return F.when((F.size(parts) > 0) & fine, F.array_distinct(numbers))


@batch_udf("array<struct<offset:int,text:string,inner:string>>")
def bracket_groups(texts: pd.Series) -> pd.Series:
    """Bracketed number groups with their character offsets; neighbours joined by a comma or dash are one group."""
    group = re.compile(r"(?<![\w\]])\[((?:\d{1,4}\s*[-–—,;]?\s*)+)\]")

    def one(t) -> list:
        out: list[dict] = []
        for m in group.finditer(t or ""):
            gap = t[out[-1]["offset"] + len(out[-1]["text"]) : m.start()] if out else None
            if gap is not None and re.fullmatch(r"\s*[,–—-]\s*", gap):
                last = out[-1]
                last["text"] = t[last["offset"] : m.end()]
                last["inner"] += gap.strip() + m[1]
            else:
                out.append({"offset": m.start(), "text": m[0], "inner": m[1]})
        return out

    return texts.map(one)


def numeric_markers(pages: DataFrame, largest: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, offset, text, targets)``; ``largest``: (doc, n), the largest printed number of its lists."""
    found = pages.join(largest, doc).select(doc, "page", "n", F.explode(bracket_groups(F.col("text"))).alias("m"))
    return found.select(doc, "page", F.col("m.offset").alias("offset"), F.col("m.text").alias("text"), cited_numbers(F.col("m.inner"), F.col("n")).alias("targets")).filter("targets IS NOT NULL")


def superscript_markers(c: Column | str) -> Column:
    """Numbers of superscripts attached to a word or stop."""
    found = F.regexp_extract_all(X.col(c), F.lit(rf"(?<=\p{{L}}{{3}}|[.,;:!?”’)])([{SUPERSCRIPTS}]+(?:[,⁻–-][{SUPERSCRIPTS}]+)*)(?![\p{{L}}\p{{N}}])"), F.lit(1))
    return F.transform(found, lambda s: F.translate(s, SUPERSCRIPTS + "⁻", "0123456789-"))


@batch_udf("array<struct<offset:int,text:string,name:string,years:array<string>>>")
def author_year_groups(texts: pd.Series) -> pd.Series:
    """Author-year citations, narrative and in brackets, with offsets; a part of years only repeats the name before it."""
    name = r"[^\W\d_a-zà-öø-ÿ][\w'’-]+"
    who = rf"((?:(?:van|von|de|del|der|la|le|al|ten)\s+)*{name}(?:\s+(?:and|&|und|et)\s+{name}|\s+et\s+al\.?)?)"
    year = r"(?:1[5-9]|20)\d\d[a-z]?"
    narrative = re.compile(rf"{who}\s+\(({year}(?:\s*,\s*(?:{year}|[a-z]))*)\)")
    inside = re.compile(rf"\(([^()]*?{year}[^()]*)\)")
    part = re.compile(rf"^(?:see\s+|e\.g\.,?\s+|cf\.\s+)?(?:{who},?\s+)?({year}(?:\s*,\s*(?:{year}|[a-z]))*)$")

    def years(t: str) -> list[str]:
        out: list[str] = []
        for y in re.split(r"\s*,\s*", t):
            out.append(out[-1][:4] + y if len(y) == 1 and out else y)
        return out

    def one(t) -> list:
        t = t or ""
        out, taken = [], []
        for m in narrative.finditer(t):
            out.append({"offset": m.start(), "text": m[0], "name": m[1], "years": years(m[2])})
            taken.append(m.span())
        for m in inside.finditer(t):
            if any(a <= m.start() < b for a, b in taken):
                continue
            last = None
            for p in m[1].split(";"):
                g = part.match(p.strip())
                if g and (g[1] or last):
                    last = g[1] or last
                    out.append({"offset": m.start(), "text": m[0], "name": last, "years": years(g[2])})
        return sorted(out, key=lambda x: x["offset"])

    return texts.map(one)


def resolve_author_year(markers: DataFrame, entries: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, page, offset, text, targets)``: citations joined to entries by first surname and year.

    ``markers``: (doc, page, offset, text, name, years); ``entries``: (doc, idx, surname, year). Letters pick the n-th
    of several entries; a letter out of range keeps all.
    """
    one = markers.select(doc, "page", "offset", "text", F.lower(F.regexp_replace(F.regexp_replace("name", r"\s+(?:and|&|und|et)\s+.*$|\s+et\s+al\.?$", ""), r"^.*\s", "")).alias("surname"), F.explode("years").alias("y"))
    one = one.select("*", F.substring("y", 1, 4).cast("int").alias("year"), F.substring("y", 5, 1).alias("letter"))
    keyed = entries.select(doc, F.lower(F.regexp_replace("surname", r"^.*\s", "")).alias("surname"), "year", "idx")
    hits = one.join(keyed, [doc, "surname", "year"]).groupBy(doc, "page", "offset", "text", "y", "letter").agg(F.array_sort(F.collect_set("idx")).alias("c"))
    nth = F.ascii("letter") - 96
    picked = F.when((F.col("letter") != "") & (F.size("c") > 1) & (nth <= F.size("c")), F.array(F.get("c", nth - 1))).otherwise(F.col("c"))
    return hits.withColumn("p", picked).groupBy(doc, "page", "offset", "text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))).alias("targets"))


def attach_links(entries: DataFrame, links: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, idx, doi_link)``: each DOI link goes to the lowest entry that starts at or above it in its column.

    ``entries``: (doc, page, idx, x0, top, page_width); ``links``: (doc, page, x0, y0, y1, uri). The page is the
    equality key, so the comparison of heights stays inside one page.
    """
    l = links.filter(F.lower("uri").rlike(r"^https?://(?:dx\.)?doi\.org/")).select(doc, "page", F.col("x0").alias("lx"), ((F.col("y0") + F.col("y1")) / 2).alias("ly"), ((F.col("y1") - F.col("y0")) / 2).alias("half"), "uri")
    near = entries.join(l, [doc, "page"]).filter((F.col("top") >= F.col("ly") - F.col("half")) & F.col("lx").between(F.col("x0") - 12, F.col("x0") + F.col("page_width") * 0.6))
    each = near.groupBy(doc, "page", "lx", "ly", "uri").agg(F.min_by("idx", F.struct("top", "idx")).alias("idx"))
    return each.groupBy(doc, "idx").agg(F.max_by("uri", F.struct("ly", "uri")).alias("uri")).select(doc, "idx", I.normalize_doi("uri").alias("doi_link"))


def pick_by_suffix(candidates: Column, suffix: Column) -> Column:
    """The n-th of several sorted candidates for the n-th letter; all of them without a letter, or for one out of range."""
    nth = F.ascii(F.lower(suffix)) - 96
    return F.when((F.size(candidates) > 1) & F.lower(suffix).rlike("^[a-z]$") & (nth <= F.size(candidates)), F.array(F.get(F.array_sort(candidates), nth - 1))).otherwise(candidates)


def narrow_by_coauthors(candidates: Column, authors: Column, second: Column, many: Column) -> Column:
    """Candidates whose number of authors, and second surname if named, fits a citation; all of them if none does.

    ``candidates``: indexes; ``authors``: surnames of each in the same order. A citation with ``many`` (et al.) has at
    least three authors, one with a second name exactly two, one with a single name any number.
    """
    paired = F.arrays_zip(candidates.alias("c"), authors.alias("a"))
    named = lambda x: F.lower(F.get(x["a"], F.lit(1))) == F.lower(second)
    fits = F.filter(paired, lambda x: F.when(many, F.size(x["a"]) >= 3).when(second.isNotNull(), (F.size(x["a"]) == 2) & F.coalesce(named(x), F.lit(False))).otherwise(F.lit(True)))
    return F.when(F.size(fits) > 0, F.transform(fits, lambda x: x["c"])).otherwise(candidates)
