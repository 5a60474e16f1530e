"""Document metadata from the first page and the file's own fields, with the provenance of each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.session import batch_udf

#: Titles and authors that programs put in (fixed values).
GENERIC_TITLES = ("untitled", "title", "document", "paper", "manuscript", "article", "main", "template", "no title", "none", "unknown", "slide 1", "powerpoint presentation")
GENERIC_AUTHORS = ("admin", "administrator", "user", "author", "owner", "unknown", "anonymous", "root", "guest", "none")


def title_is_generic(c: Column | str) -> Column:
    """Empty, a placeholder, a file name or a program's name."""
    t = F.lower(F.trim(X.col(c)))
    return (t == "") | t.isin(*GENERIC_TITLES) | t.rlike(r"\.(?:pdf|docx?|tex|dvi|ps|indd|qxd|pptx?)$") | t.rlike(r"^(?:microsoft word|untitled|doi:|arxiv:)") | ~t.rlike(r"\p{L}{3}")


def author_is_generic(c: Column | str) -> Column:
    """A login or placeholder name."""
    t = F.lower(F.trim(X.col(c)))
    return (t == "") | t.isin(*GENERIC_AUTHORS) | t.rlike(r"^[a-z]+[0-9]+$") | ~t.rlike(r"\p{L}{2}")


def split_author_names(c: Column | str) -> Column:
    """Printed author list as names."""
    parts = F.split(X.col(c), r"\s*(?:;|,(?!\s*(?:Jr|Sr|II|III|PhD|MD)\b)|\band\b|&|\n)\s*")
    cleaned = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[0-9*†‡§¶⁰¹²³⁴⁵⁶⁷⁸⁹]+", "")))
    return F.filter(cleaned, lambda p: p != "")


def split_keywords(c: Column | str) -> Column:
    parts = F.split(F.regexp_replace(X.col(c), r"^(?i)\s*(?:key\s?words?|index terms)\s*[:—–-]\s*", ""), r"\s*[;,·•]\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), r"\.$", "")), lambda p: p != "")


_PARTICLES = frozenset("van von der den de la del di da le ten al bin y e".split())


def looks_like_person_name(candidate: str) -> bool:
    """Two to six short words, at least two capitalised, particles and suffixes allowed."""
    words = candidate.strip(" ,.;").split()
    if not 2 <= len(words) <= 6 or any(len(w) > 25 for w in words) or re.search(r"\d|@|https?:", candidate):
        return False
    capital = 0
    for w in words:
        if w.lower().strip(".") in _PARTICLES or w.strip(".,") in ("Jr", "Sr", "II", "III", "IV"):
            continue
        if not w[:1].isupper():
            return False
        capital += 1
    return capital >= 2


@batch_udf("boolean")
def is_person_name(names: pd.Series) -> pd.Series:
    return names.map(lambda n: looks_like_person_name(n) if isinstance(n, str) else False)


def title_block(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, title)``: the first run of the largest lines in the upper part of page 1, larger than the median by half a point.

    ``lines``: (doc, page, line_idx, text, size, y1, page_height).
    """
    first = lines.filter((F.col("page") == 1) & (F.length("text") >= 3) & F.col("text").rlike(r"\p{L}") & (F.col("y1") >= F.col("page_height") * 0.4))
    whole = Window.partitionBy(doc)
    x = first.withColumn("most", F.max("size").over(whole)).withColumn("usual", F.expr("percentile(size, 0.5)").over(whole)).filter(F.col("most") > F.col("usual") + 0.5)
    x = x.withColumn("large", F.col("size") >= F.col("most") - 0.5)
    w = Window.partitionBy(doc).orderBy("line_idx")
    x = x.withColumn("breaks", F.sum((~F.col("large")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.filter("large").groupBy(doc, "breaks").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), " ").alias("title"))
    return runs.groupBy(doc).agg(F.min_by("title", "breaks").alias("title"))


def page1_abstract(lines: DataFrame, doc: str = "doc_hash", most: int = 80) -> DataFrame:
    """``(doc, abstract)``: what follows the heading on page 1 up to the next heading, at most ``most`` lines."""
    w = Window.partitionBy(doc).orderBy("line_idx")
    x = lines.filter("page = 1").select(doc, "line_idx", "text", F.col("text").rlike(r"^(?i)\s*abstract\b").alias("start"), F.col("text").rlike(r"^(?i)\s*(?:(?:[0-9IVX]+\.?\s+)?(?:introduction|background|methods?)\s*$|key\s?words?\b|index terms\b|1\.?\s+\p{Lu})").alias("stop"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("open", F.max(F.col("start").cast("int")).over(upto)).withColumn("closed", F.max((F.col("stop") & ~F.col("start")).cast("int")).over(upto))
    inside = x.filter("open = 1 AND closed = 0").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most + 1)
    joined = inside.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "text"))), lambda s: s["text"]), " ").alias("a"))
    return joined.select(doc, F.nullif(F.trim(F.regexp_replace("a", r"^(?i)\s*abstract\s*[.:—–-]?\s*", "")), F.lit("")).alias("abstract"))


def page1_doi(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, doi, rank)``: of the DOIs on page 1, in order: labelled in a header, labelled, in a header, of a preprint, in running text."""
    x = lines.filter("page = 1").withColumn("doi", F.lower(I.find_doi("text"))).filter("doi IS NOT NULL")
    header = (F.col("y1") >= F.col("page_height") * 0.9) | (F.col("y0") <= F.col("page_height") * 0.1)
    label = F.col("text").rlike(r"(?i)doi\s*[:.]|doi\.org")
    rank = F.when(I.arxiv_from_doi("doi").isNotNull(), 4).when(header & label, 1).when(label, 2).when(header, 3).otherwise(5)
    return x.withColumn("rank", rank).groupBy(doc).agg(F.min_by("doi", F.struct("rank", "line_idx")).alias("doi"), F.min("rank").alias("rank"))


def choose(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first known value and the name of where it came from."""
    value = F.coalesce(*[c for _, c in candidates])
    source = F.lit(None).cast("string")
    for name, c in reversed(candidates):
        source = F.when(c.isNotNull(), F.lit(name)).otherwise(source)
    return value, source


def merge_metadata(rows: DataFrame) -> DataFrame:
    """Fields by precedence with a provenance map.

    ``rows``: (doc_hash, info_title, info_author, info_date, info_subject, page_title, page_doi, page_year, arxiv_id).
    """
    title, t_from = choose([("info", F.when(~title_is_generic("info_title"), F.col("info_title"))), ("page1", F.col("page_title"))])
    doi, d_from = choose([("info", F.lower(I.find_doi("info_subject"))), ("page1", F.col("page_doi"))])
    year, y_from = choose([("arxiv", I.year_from_arxiv("arxiv_id")), ("doi", F.when(I.arxiv_from_doi(doi).isNull(), I.first_year(F.regexp_replace(doi, r"^10\.[0-9]+/", "")))), ("info", I.year_from_pdf_date("info_date")), ("page1", F.col("page_year"))])
    authors = F.when(~author_is_generic("info_author"), split_author_names("info_author"))
    pairs = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(n).alias("key"), s.alias("value"))) for n, s in (("title", t_from), ("doi", d_from), ("year", y_from))]))
    return rows.select("doc_hash", title.alias("title"), authors.alias("authors"), doi.alias("doi"), year.alias("year"), F.map_from_entries(pairs).alias("provenance"))


def page1_year(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, year)``: the first year of page 1, lines with a word of publication before others."""
    x = lines.filter("page = 1").withColumn("year", I.first_year("text")).filter("year IS NOT NULL")
    dated = F.col("text").rlike(r"(?i)publish|accept|received|copyright|©|\bdate\b|\bvol(?:ume|\.)")
    return x.groupBy(doc).agg(F.min_by("year", F.struct((~dated).alias("other"), "line_idx")).alias("year"))


def page1_keywords(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, keywords)``: those on the first line of page 1 that opens with their heading, or on the next one if it holds nothing else."""
    w = Window.partitionBy(doc).orderBy("line_idx")
    x = lines.filter("page = 1").withColumn("next", F.lead("text").over(w)).filter(F.col("text").rlike(r"^(?i)\s*(?:key\s?words?|index terms)\b"))
    x = x.withColumn("n", F.row_number().over(w)).filter("n = 1")
    own = split_keywords("text")
    alone = F.col("text").rlike(r"^(?i)\s*(?:key\s?words?|index terms)\s*[:—–-]?\s*$")
    return x.select(doc, F.when(alone, split_keywords(F.coalesce("next", F.lit("")))).otherwise(own).alias("keywords")).filter(F.size("keywords") > 0)


def page1_publisher_doi(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, doi, source)``: a DOI of page 1 that a publisher printed: in a header or footer, else with its label; never a preprint's."""
    x = lines.filter("page = 1").withColumn("doi", F.lower(I.find_doi("text"))).filter(F.col("doi").isNotNull() & I.arxiv_from_doi("doi").isNull())
    edge = (F.col("y1") >= F.col("page_height") * 0.9) | (F.col("y0") <= F.col("page_height") * 0.1)
    source = F.when(edge, "furniture").when(F.col("text").rlike(r"(?i)doi\s*[:.]|doi\.org"), "label")
    x = x.withColumn("source", source).filter("source IS NOT NULL")
    return x.groupBy(doc).agg(F.min_by(F.struct("doi", "source"), F.struct("source", "line_idx")).alias("b")).select(doc, "b.doi", "b.source")
