"""Identifiers and years in text, as Catalyst expressions. No match gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import col

DOI = r"10\.[0-9]{4,9}/[^\s\"<>]+"


def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def trim_doi(c: Column) -> Column:
    """Without punctuation at the end and without a closing bracket that opens nowhere."""
    x = F.regexp_replace(c, r"[.,;:'\"”’\]}>*]+$", "")
    opened, closed = F.length(F.regexp_replace(x, r"[^(]", "")), F.length(F.regexp_replace(x, r"[^)]", ""))
    return F.when(closed > opened, F.regexp_replace(F.regexp_replace(x, r"\)[^)]*$", ""), r"[.,;:]+$", "")).otherwise(x)


def find_doi(c: Column | str) -> Column:
    """The first DOI of a text, as printed."""
    return F.nullif(trim_doi(first_match(c, DOI)), F.lit(""))


def normalize_doi(c: Column | str) -> Column:
    """Bare lower-case DOI of a DOI, label or resolver address; null if there is none at its start."""
    bare = F.regexp_replace(F.trim(col(c)), r"^(?i)(?:https?://)?(?:dx\.)?(?:doi\.org/|doi\.[a-z]+/)?(?:doi\s*:?\s*)?", "")
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/\S"), F.lower(trim_doi(first_match(bare, "^" + DOI))))


def all_dois(c: Column | str) -> Column:
    """Distinct lower-case DOIs in order of appearance."""
    found = F.transform(F.regexp_extract_all(col(c), F.lit(DOI), F.lit(0)), lambda x: F.lower(trim_doi(x)))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def is_placeholder_doi(c: Column | str) -> Column:
    """A DOI of a template: no digit or letter of its own after the slash."""
    return col(c).rlike(r"^10\.[0-9]+/[nx._#-]+$")


ARXIV = r"(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})"


def find_arxiv(c: Column | str) -> Column:
    """The first arXiv id after its label or in its address, without version."""
    return first_match(c, rf"(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)({ARXIV})(?:v[0-9]+)?", 1)


def normalize_arxiv(c: Column | str) -> Column:
    """Bare arXiv id without label and version; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(col(c)), r"^(?i)(?:https?://)?(?:arxiv\.org/(?:abs|pdf)/)?(?:arxiv\s*:\s*)?", ""), r"(?i)(?:\.pdf)?(?:v[0-9]+)?(?:\.pdf)?$", "")
    return F.when(bare.rlike(rf"^{ARXIV}$"), F.lower(bare))


def arxiv_from_doi(c: Column | str) -> Column:
    return first_match(F.lower(col(c)), r"^10\.48550/arxiv\.(.+)$", 1)


def year_from_arxiv(c: Column | str) -> Column:
    """Year of an arXiv id: new ids are of 20xx, old ones of 19xx from 90 on."""
    yy = F.coalesce(first_match(c, r"^([0-9]{2})[0-9]{2}\.", 1), first_match(c, r"/([0-9]{2})[0-9]{5}$", 1)).cast("int")
    return F.when(col(c).contains("/") & (yy >= 90), yy + 1900).otherwise(yy + 2000)


def normalize_pmcid(c: Column | str) -> Column:
    return F.concat(F.lit("PMC"), first_match(F.upper(F.trim(col(c))), r"^(?:PMC)?([0-9]+)$", 1))


def normalize_pmid(c: Column | str) -> Column:
    return first_match(F.trim(col(c)), r"^[0-9]{1,9}$")


def biomedical_ids(c: Column | str) -> Column:
    """Labelled PMIDs, then PMCIDs, distinct."""
    pm = F.regexp_extract_all(col(c), F.lit(r"(?i)\bPMID\s*:?\s*([0-9]{1,9})"), F.lit(1))
    pmc = F.transform(F.regexp_extract_all(col(c), F.lit(r"(?i)\bPMC\s*:?\s*([0-9]{3,9})"), F.lit(1)), lambda x: F.concat(F.lit("PMC"), x))
    return F.array_distinct(F.concat(pm, pmc))


def find_url(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(first_match(c, r"(?i)https?://[^\s<>\"]+"), r"[.,;:)\]}'”’]+$", ""), F.lit(""))


def all_years(c: Column | str) -> Column:
    """Stand-alone years 1500 to 2099."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"(?<![0-9])(1[5-9][0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))


def find_year(c: Column | str) -> Column:
    """A year in brackets, else the first one that is no end of a range."""
    year = r"((?:1[5-9]|20)[0-9]{2})"
    return F.coalesce(first_match(c, rf"\({year}[a-z]?\)", 1), first_match(c, rf"(?<![0-9–-]){year}[a-z]?(?![0-9–-])", 1)).cast("int")


def first_year(c: Column | str) -> Column:
    """The first stand-alone year of 19xx or 20xx."""
    return first_match(c, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).cast("int")


def year_from_date(c: Column | str) -> Column:
    """The first run of exactly four digits from 1000 to 2999."""
    return first_match(c, r"(?<![0-9])([12][0-9]{3})(?![0-9])", 1).cast("int")


def year_from_pdf_date(c: Column | str) -> Column:
    y = first_match(c, r"^(?:D:)?([0-9]{4})", 1).cast("int")
    return F.when(y.between(1900, 2099), y)


def strip_label(c: Column | str) -> Column:
    """An entry without its printed label."""
    return F.regexp_replace(col(c), r"^\s*(?:\[[^\]]{1,12}\]|\([0-9]{1,4}\)|[0-9]{1,4}\.(?=\s))\s*", "")


def has_reference_evidence(c: Column | str) -> Column:
    """A year, a note that there is none, a DOI, arXiv id or address."""
    t = col(c)
    return t.rlike(r"(?<![0-9])(?:1[5-9]|20)[0-9]{2}(?![0-9])") | t.rlike(r"(?i)\bn\.\s?d\.|in press|forthcoming|to appear") | t.rlike(DOI) | t.rlike(r"(?i)\barxiv\b") | t.rlike(r"(?i)https?://")


def dash_range(first: Column, last: Column) -> Column:
    """Pages as ``first–last``, or the first alone."""
    return F.when(last.isNull() | (last == ""), first).otherwise(F.concat(first, F.lit("–"), last))


def parse_numbers(c: Column | str) -> Column:
    """struct(volume, issue, pages) of an entry's tail: the first of several printed orders that fits."""
    t = col(c)
    page = r"([A-Za-z]?[0-9]+)\s*[-–—]+\s*([A-Za-z]?[0-9]+)"
    orders = (
        (rf"(?i)([0-9]+)\s*\(([0-9]+(?:[-–/][0-9]+)?)\)\s*[:,;]\s*(?:pp?\.?\s*)?{page}", (1, 2, 3, 4)),
        (rf"(?i)vol(?:ume|\.)?\s*([0-9]+)\s*[,/ ]\s*(?:no\.?|issue)?\s*([0-9]+)\s*,\s*(?:pp?\.?\s*){page}", (1, 2, 3, 4)),
        (rf"(?i)\bvol(?:ume|\.)?\s*([0-9]+)()[^0-9]+(?:pp?\.?\s*){page}", (1, 2, 3, 4)),
        (rf"([0-9]+)()\s*[:]\s*{page}", (1, 2, 3, 4)),
        (rf"(?i)([0-9]+)()\s*,\s*(?:pp?\.?\s*){page}", (1, 2, 3, 4)),
        (r"([0-9]+)\s*\(([0-9]+)\)()()", (1, 2, 3, 4)),
        (rf"(?i)()()pp?\.?\s*{page}", (1, 2, 3, 4)),
    )
    get = lambda p, g: F.nullif(F.regexp_extract(t, p, g), F.lit(""))
    out = F.lit(None).cast("struct<volume:string,issue:string,pages:string>")
    for p, (v, i, a, b) in reversed(orders):
        out = F.when(t.rlike(p), F.struct(get(p, v).alias("volume"), get(p, i).alias("issue"), F.when(get(p, a).isNotNull(), dash_range(get(p, a), get(p, b))).alias("pages"))).otherwise(out)
    return out


def surname(c: Column | str) -> Column:
    """Surname of a printed name: what stands before a comma, else the last word, in lower case."""
    t = F.trim(col(c))
    return F.lower(F.when(t.contains(","), F.trim(F.substring_index(t, ",", 1))).otherwise(F.element_at(F.split(t, r"\s+"), -1)))


def author_year_label(authors: Column, year: Column) -> Column:
    """Label such as Smith2020; null if a part is unknown."""
    return F.concat(F.initcap(surname(F.get(authors, 0))), year.cast("string"))


def arxiv_ids_in_text(c: Column | str, most: int = 64) -> Column:
    """Distinct arXiv ids after their label, in order, at most ``most``."""
    found = F.regexp_extract_all(col(c), F.lit(rf"(?i)arxiv\s*:\s*({ARXIV})(?:v[0-9]+)?"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.lower(x))), 1, most)


#: Ends of publishers' addresses that are no part of a DOI (fixed values).
DOI_TAILS = r"(?i)/(?:full|abstract|pdf|epdf|pdfdirect|fulltext|meta|html|summary|references|supplementary)(?:/.*)?$|\.pdf$|\.full(?:\.pdf)?$"


def dois_in_url(c: Column | str) -> Column:
    """DOIs in an address, escapes decoded, publishers' tails cut."""
    path = F.try_url_decode(F.regexp_replace(col(c), r"[?#].*$", ""))
    return F.array_distinct(F.transform(all_dois(F.coalesce(path, col(c))), lambda d: F.regexp_replace(d, DOI_TAILS, "")))


def list_plausible(labels: Column, years: Column, entries: Column) -> Column:
    """A list's largest printed label is at most one above its entries, and it has at most 1.5 years an entry and 3 more."""
    return (F.coalesce(F.array_max(labels), F.lit(0)) <= entries + 1) & (F.size(years) <= entries * 1.5 + 3)
