"""Queries of the scan for reference lists, first pages and citation choice, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import web as W
from quillmill.operators import bibliography as B
from quillmill.operators import citations as C
from quillmill.operators import evaluate as E
from quillmill.operators import metadata as M
from quillmill.operators import resolve as V
from quillmill.plans.registry import Registry
from quillmill.session import table

QUERIES = Registry()
q = QUERIES.query

_PAGES = "(SELECT doc_hash, page, string_agg(coalesce(text, ''), chr(10) ORDER BY idx, chunk_id) AS text FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks) WHERE doc_hash IS NOT NULL GROUP BY ALL)"
_DOCS = "(SELECT doc_id AS doc_hash, 1 AS page, text FROM documents)"
_HEAD = "|".join(B.HEADINGS)
_EVIDENCE = r"""(regexp_matches(line, '(?:^|[^0-9])(?:1[5-9]|20)[0-9]{2}(?:[^0-9]|$)') OR regexp_matches(line, '(?i)\bn\.\s?d\.|in press|forthcoming|to appear') OR regexp_matches(line, '10\.[0-9]{4,9}/[^\s"<>]+') OR regexp_matches(line, '(?i)\barxiv\b') OR regexp_matches(line, '(?i)https?://'))"""


def _scan(pages: str) -> str:
    lines = f"(SELECT doc_hash, page, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM {pages})"
    label = r"regexp_extract(line, '^\s*(?:\[([0-9]{1,4})\]|([0-9]{1,4})\.\s)')"
    # Years are counted without their neighbours: the text between two of them is not taken twice.
    years = r"len(regexp_extract_all(regexp_replace(line, '([0-9]+)', ' \1 ', 'g'), ' (?:1[5-9][0-9]{2}|20[0-9]{2}) '))"
    return rf"""WITH l AS (SELECT *, regexp_matches(lower(line), '^\s*(?:[0-9]+\.?\s+)?(?:{_HEAD})\s*:?\s*$') AS heading, {label} <> '' OR (regexp_matches(line, '^\s*\p{{Lu}}[\p{{L}}''’-]+,?\s') AND {_EVIDENCE} AND length(line) >= 30) AS entry,
                       TRY_CAST(regexp_extract({label}, '[0-9]+') AS INT) AS n, {years} AS y FROM {lines}),
                b AS (SELECT *, coalesce(sum(CAST(entry AS INT)) OVER w, 0) AS entries, coalesce(max(n) OVER w, 0) AS top, coalesce(sum(y) OVER w, 0) AS years FROM l WINDOW w AS (PARTITION BY doc_hash ORDER BY page DESC, line_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
                f AS (SELECT * FROM b WHERE heading AND entries >= 3 QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY page DESC, line_no DESC) = 1),
                c AS (SELECT doc_hash, count(DISTINCT page) AS n_pages, max(page) AS last_page FROM {pages} GROUP BY doc_hash)
                SELECT doc_hash, f.page, f.line_no, CAST(coalesce(entries, 0) AS BIGINT) AS entries, coalesce(top <= entries + 1 AND years <= entries * 1.5 + 3, false) AS plausible, f.page IS NOT NULL AS complete, coalesce(last_page - f.page + 1, n_pages) AS pages_read FROM c LEFT JOIN f USING (doc_hash)"""


def _pages(spark, d):
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"]).filter("doc_hash IS NOT NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return c.groupBy("doc_hash", "page").agg(text.alias("text"))


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc_hash"), F.lit(1).alias("page"), "text")


@q(_scan(_DOCS))
def reference_scans(spark, d):
    """Where each document's reference list begins, how many entries it has and whether they are plausible."""
    return B.scan_backward(_documents(spark, d))


@q(_scan(_PAGES))
def backward_scans(spark, d):
    """The same page by page, with the number of pages that had to be read."""
    return B.scan_backward(_pages(spark, d))


@q(f"""WITH a AS ({_scan(_DOCS)}), b AS ({_scan("(SELECT doc_id AS doc_hash, 1 AS page, text || chr(10) || 'References' || chr(10) || '[1] A 2001' || chr(10) || '[2] B 2002' || chr(10) || '[3] C 2003' AS text FROM documents)")}),
       u AS (SELECT *, 0 AS i FROM a UNION ALL SELECT b.*, 1 FROM b JOIN a USING (doc_hash) WHERE NOT (a.complete AND a.plausible))
       SELECT doc_hash, arg_max(CASE WHEN i = 0 THEN 'first' ELSE 'second' END, (complete, plausible, entries, -i)) AS route, string_agg(CASE WHEN i = 0 THEN 'first' ELSE 'second' END, '>' ORDER BY i) AS tried, max(complete) AS complete FROM u GROUP BY doc_hash""".replace("max(complete)", "bool_or(complete)"))
def routed_scans(spark, d):
    """Scans with a second result for documents whose first one holds no plausible list."""
    a = _documents(spark, d)
    more = F.concat("text", F.lit("\nReferences\n[1] A 2001\n[2] B 2002\n[3] C 2003"))
    return B.scan_auto(a, a.withColumn("text", more)).select("doc_hash", "route", "tried", "complete")


_LINES = "(SELECT doc_hash, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM " + _PAGES + " WHERE page = 1)"


def _first_lines(spark, d):
    x = _pages(spark, d).filter("page = 1").select("doc_hash", "page", F.posexplode(F.split("text", "\n")).alias("line_idx", "text"))
    return x.withColumns({"y0": F.when(F.col("line_idx") < 2, F.lit(95.0)).otherwise(F.lit(50.0)), "y1": F.when(F.col("line_idx") < 2, F.lit(99.0)).otherwise(F.lit(55.0)), "page_height": F.lit(100.0)})


@q(rf"""SELECT doc_hash, CAST(arg_min(y, (NOT dated, line_idx)) AS INT) AS year FROM (SELECT *, nullif(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9]{{2}})(?:[^0-9]|$)', 1), '') AS y, regexp_matches(text, '(?i)publish|accept|received|copyright|©|\bdate\b|\bvol(?:ume|\.)') AS dated FROM {_LINES}) WHERE y IS NOT NULL GROUP BY doc_hash""")
def first_page_years(spark, d):
    """Year of every document's first page."""
    return M.page1_year(_first_lines(spark, d))


@q("""SELECT doc_hash, lower(doi) AS doi, CASE WHEN left(doc_hash, 1) < '8' THEN 'furniture' ELSE 'label' END AS source FROM (SELECT doc_hash, min(doi) AS doi FROM search_chunks WHERE doc_hash IS NOT NULL GROUP BY doc_hash) WHERE regexp_matches(doi, '^10\\.[0-9]{4,9}/[^\\s"<>]*[A-Za-z0-9]$') AND NOT starts_with(lower(doi), '10.48550/arxiv.')""")
def first_page_dois(spark, d):
    """DOI that the publisher printed on every document's first page: in the footer, or with its label in the text; the preprint's beside it is left."""
    c = table(spark, d, "search_chunks").filter("doc_hash IS NOT NULL").groupBy("doc_hash").agg(F.min("doi").alias("doi"))
    footer = F.substring("doc_hash", 1, 1) < "8"
    page = F.array(F.lit("doi:10.48550/arXiv.2001.00001"), F.when(~footer, F.concat(F.lit("DOI: "), "doi")).otherwise(F.lit("text")), F.lit("see also 10.1000/other"), F.when(footer, F.concat(F.lit("Journal, "), "doi")).otherwise(F.lit("page 1")))
    lines = c.select("doc_hash", F.lit(1).alias("page"), F.posexplode(page).alias("line_idx", "text"))
    return M.page1_publisher_doi(lines.withColumns({"y0": F.when(F.col("line_idx") == 3, F.lit(2.0)).otherwise(F.lit(50.0)), "y1": F.when(F.col("line_idx") == 3, F.lit(6.0)).otherwise(F.lit(55.0)), "page_height": F.lit(100.0)}))


@q(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(title, 'none'), '\s*[;,·•]\s*'), lambda p: regexp_replace(trim(p), '\.$', '')), lambda p: p <> '') AS keywords FROM documents WHERE regexp_matches(coalesce(title, 'none'), '[^\s;,·•.]')""")
def first_page_keywords(spark, d):
    """Keywords under their heading, on the line after it for every second document."""
    t = F.coalesce("title", F.lit("none"))
    pages = table(spark, d, "documents").filter(t.rlike(r"[^\s;,·•.]")).select(F.col("doc_id"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A title"), F.lit("Keywords:"), t)).otherwise(F.array(F.lit("A title"), F.concat(F.lit("Key words: "), t))).alias("ls"))
    lines = pages.select("doc_id", "page", F.posexplode("ls").alias("line_idx", "text"))
    return M.page1_keywords(lines, "doc_id")


@q("""SELECT run_key, surname, year, CASE WHEN len(c) > 1 THEN [list_sort(c)[2]] ELSE c END AS second, list_sort(c) AS all_of_them FROM (SELECT run_key, surname, year, list_sort(list(idx)) AS c FROM extracted_refs WHERE surname IS NOT NULL AND year IS NOT NULL GROUP BY ALL)""")
def suffix_choice(spark, d):
    """Of the references of one author and year, the one with the letter b; a letter out of range keeps all."""
    x = table(spark, d, "extracted_refs").filter("surname IS NOT NULL AND year IS NOT NULL").groupBy("run_key", "surname", "year").agg(F.array_sort(F.collect_list("idx")).alias("c"))
    return x.select("run_key", "surname", "year", C.pick_by_suffix(F.col("c"), F.lit("b")).alias("second"), F.array_sort(C.pick_by_suffix(F.col("c"), F.lit("!"))).alias("all_of_them"))


@q("""SELECT run_key, surname, year, CASE WHEN len(list_filter(c, lambda x: x.n >= 3)) > 0 THEN list_transform(list_filter(c, lambda x: x.n >= 3), lambda x: x.idx) ELSE list_transform(c, lambda x: x.idx) END AS many
      FROM (SELECT run_key, surname, year, list_sort(list({'idx': idx, 'n': coalesce(len(authors), 0)})) AS c FROM extracted_refs WHERE surname IS NOT NULL AND year IS NOT NULL GROUP BY ALL)""")
def coauthor_choice(spark, d):
    """Of the references of one author and year, those with at least three authors, as et al. says; all of them if there are none."""
    x = table(spark, d, "extracted_refs").filter("surname IS NOT NULL AND year IS NOT NULL").groupBy("run_key", "surname", "year").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("authors", F.array().cast("array<string>")).alias("a")))).alias("c"))
    return x.select("run_key", "surname", "year", C.narrow_by_coauthors(F.transform("c", lambda s: s["idx"]), F.transform("c", lambda s: s["a"]), F.lit(None).cast("string"), F.lit(True)).alias("many"))


@q("""SELECT doc, t_idx, e_idx FROM (SELECT doc, t_idx, row_number() OVER (PARTITION BY doc, g ORDER BY t_idx) AS n, g FROM m) t JOIN (SELECT doc, e_idx, g, row_number() OVER (PARTITION BY doc, g ORDER BY e_idx) AS n FROM m) e USING (doc, g, n)""".replace(" m)", " (SELECT run_key AS doc, idx AS t_idx, -idx AS e_idx, year AS g FROM extracted_refs WHERE year IS NOT NULL))") + " UNION ALL SELECT run_key, idx, -idx FROM extracted_refs WHERE year IS NULL")
def ordered_duplicates(spark, d):
    """Matches of one year's entries, given out in order."""
    e = table(spark, d, "extracted_refs").select(F.col("run_key").alias("doc"), F.col("idx").alias("t_idx"), (-F.col("idx")).alias("e_idx"), F.col("year").alias("g"))
    return E.order_duplicates(e.select("doc", "t_idx", "e_idx"), e.filter("g IS NOT NULL").select("doc", "t_idx", "g"))


@q("""SELECT CAST(ref_id AS BIGINT) AS entry_id, CAST(ref_id AS BIGINT) AS record_id, CAST(ref_id AS VARCHAR) AS identifier, 'mismatch' AS outcome FROM source_refs""")
def biomedical_mismatches(spark, d):
    """Entries that print the identifier of a record which is not theirs: another year and no word in common."""
    r = table(spark, d, "source_refs")
    entries = r.select(F.col("ref_id").alias("entry_id"), F.concat(F.lit("Quux Zyx. 1066. PMID: "), F.col("ref_id").cast("string")).alias("raw"))
    records = r.select(F.col("ref_id").alias("record_id"), F.col("ref_id").cast("string").alias("identifier"), V.folded(F.coalesce("title", F.lit("untitled record"))).alias("title"), F.lit("nobody").alias("author"), F.lit(1900).alias("year"))
    return V.select_biomedical(entries, records)


@q("""SELECT doc_id, 'https://scholar.google.com/scholar?q=' || url_encode(title) AS url FROM documents WHERE title IS NOT NULL""")
def scholar_addresses(spark, d):
    """Search addresses of document titles."""
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", W.scholar_search_url(F.col("title")).alias("url"))
