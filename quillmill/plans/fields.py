"""Queries of identifiers, years, names, addresses and the ledger over the stored columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.functions import vectors as V
from quillmill.functions import web as W
from quillmill.operators import evaluate as E
from quillmill.operators import ledger as L
from quillmill.operators import metadata as M
from quillmill.operators import records as R
from quillmill.operators import resolve as C
from quillmill.operators import search as S
from quillmill.plans.registry import Registry
from quillmill.session import table
from quillmill.sources import files

QUERIES = Registry()
q = QUERIES.query

ALNUM = r"'[^\p{L}\p{N}]+'"
WORDS = rf"list_filter(string_split(trim(regexp_replace(lower({{0}}), {ALNUM}, ' ', 'g')), ' '), lambda w: w <> '')"
# A DOI without closing punctuation, and without a bracket that opens nowhere.
TRIMMED = r"""regexp_replace({0}, '[.,;:''"”’\]}>*]+$', '')"""
DOI = r"""'10\.[0-9]{4,9}/[^\s"<>]+'"""
ARXIV = r"(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})"



def _put(template: str, x: str) -> str:
    return template.replace("{0}", x)


def _trim(x: str) -> str:
    t = _put(TRIMMED, x)
    more = rf"length(regexp_replace({t}, '[^)]', '', 'g')) > length(regexp_replace({t}, '[^(]', '', 'g'))"
    return rf"CASE WHEN {more} THEN regexp_replace(regexp_replace({t}, '\)[^)]*$', ''), '[.,;:]+$', '') ELSE {t} END"


def _refs(spark, d, *columns):
    return table(spark, d, "extracted_refs").select("ext_id", *columns)


def _manifest(spark, d):
    return table(spark, d, "manifest_items").dropDuplicates(["pmcid", "version"])


MANIFEST = "(SELECT DISTINCT ON (pmcid, version) * FROM manifest_items)"


# --- identifiers ----------------------------------------------------------------------------------------------------


@q(rf"""SELECT ext_id, CASE WHEN f <> '' THEN f END AS doi, array_to_string(list_distinct(a), ' ') AS dois, len(list_distinct(a)) > 1 AS ambiguous
        FROM (SELECT ext_id, raw, {_trim(f'regexp_extract(raw, {DOI})')} AS f, list_sort(list_filter(list_transform(regexp_extract_all(raw, {DOI}), lambda x: lower({_trim('x')})), lambda x: x <> '')) AS a FROM extracted_refs WHERE raw IS NOT NULL)""".replace("array_to_string(list_distinct(a), ' ')", "array_to_string(list_sort(list_distinct(a)), ' ')"))
def printed_dois(spark, d):
    """The first DOI of each entry, all its distinct ones in order of the alphabet, and whether there are several."""
    e = _refs(spark, d, "raw").filter("raw IS NOT NULL")
    return e.select("ext_id", I.find_doi("raw").alias("doi"), F.array_join(F.array_sort(I.all_dois("raw")), " ").alias("dois"), C.ambiguous_printed_dois(F.col("raw")).alias("ambiguous"))


@q(r"""SELECT ext_id, regexp_matches(doi, '^10\.[0-9]+/[nx._#-]+$') AS placeholder, CASE WHEN x <> '' THEN x END AS arxiv
       FROM (SELECT ext_id, doi, regexp_extract(lower(doi), '^10\.48550/arxiv\.(.+)$', 1) AS x FROM extracted_refs WHERE doi IS NOT NULL)""")
def doi_kinds(spark, d):
    """Placeholder DOIs and DOIs of preprints."""
    return _refs(spark, d, "doi").filter("doi IS NOT NULL").select("ext_id", I.is_placeholder_doi("doi").alias("placeholder"), I.arxiv_from_doi("doi").alias("arxiv"))


@q(rf"""SELECT ext_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(url_decode(regexp_replace(doi_link, '[?#].*$', '')), {DOI}), lambda x: lower({_trim('x')})), lambda x: x <> ''), lambda x: regexp_replace(x, '(?i)/(?:full|abstract|pdf|epdf|pdfdirect|fulltext|meta|html|summary|references|supplementary)(?:/.*)?$|\.pdf$|\.full(?:\.pdf)?$', '')))), ' ') AS dois
        FROM extracted_refs WHERE doi_link IS NOT NULL""")
def link_dois(spark, d):
    """DOIs in the links of entries."""
    return _refs(spark, d, "doi_link").filter("doi_link IS NOT NULL").select("ext_id", F.array_join(F.array_sort(I.dois_in_url("doi_link")), " ").alias("dois"))


@q(rf"""SELECT ext_id, nullif(regexp_extract(t, '(?i)(?:arxiv\s*:\s*|arxiv\.org/(?:abs|pdf)/)({ARXIV})(?:v[0-9]+)?', 1), '') AS found,
               array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)arxiv\s*:\s*({ARXIV})(?:v[0-9]+)?', 1), lambda x: lower(x)))), ' ') AS all_ids,
               CASE WHEN regexp_full_match(b, '{ARXIV}') THEN lower(b) END AS bare,
               CASE WHEN regexp_full_match(b, '{ARXIV}') THEN CASE WHEN contains(b, '/') AND CAST(coalesce(nullif(regexp_extract(b, '^([0-9]{{2}})[0-9]{{2}}\.', 1), ''), nullif(regexp_extract(b, '/([0-9]{{2}})[0-9]{{5}}$', 1), '')) AS INT) >= 90 THEN 1900 ELSE 2000 END
                 + CAST(coalesce(nullif(regexp_extract(b, '^([0-9]{{2}})[0-9]{{2}}\.', 1), ''), nullif(regexp_extract(b, '/([0-9]{{2}})[0-9]{{5}}$', 1), '')) AS INT) END AS year
        FROM (SELECT ext_id, raw || ' arXiv:' || coalesce(arxiv_id, '') || 'v2' AS t,
                     regexp_replace(regexp_replace(trim(arxiv_id), '^(?i:(?:https?://)?(?:arxiv\.org/(?:abs|pdf)/)?(?:arxiv\s*:\s*)?)', ''), '(?i:(?:\.pdf)?(?:v[0-9]+)?(?:\.pdf)?)$', '') AS b
              FROM extracted_refs WHERE raw IS NOT NULL)""")
def arxiv_identifiers(spark, d):
    """arXiv ids in and beside the entries, their bare form and year."""
    t = F.concat("raw", F.lit(" arXiv:"), F.coalesce("arxiv_id", F.lit("")), F.lit("v2"))
    bare = I.normalize_arxiv("arxiv_id")
    e = _refs(spark, d, "raw", "arxiv_id").filter("raw IS NOT NULL")
    return e.select("ext_id", I.find_arxiv(t).alias("found"), F.array_join(F.array_sort(I.arxiv_ids_in_text(t)), " ").alias("all_ids"), bare.alias("bare"), I.year_from_arxiv(bare).alias("year"))


@q(rf"""SELECT pmcid, version, 'PMC' || regexp_extract(pmcid, '[0-9]+') AS pmc, nullif(regexp_extract(trim(CAST(pmid AS VARCHAR)), '^[0-9]{{1,9}}$'), '') AS pm,
               CASE WHEN pmid IS NULL THEN '' ELSE CAST(pmid AS VARCHAR) || ' ' END || 'PMC' || regexp_extract(pmcid, '[0-9]+') AS ids
        FROM {MANIFEST}""")
def biomedical_identifiers(spark, d):
    """PMCIDs and PMIDs in their bare form, and as found in a text that prints them."""
    pmid = F.col("pmid").cast("string")
    printed = F.concat(F.coalesce(F.concat(F.lit("see PMID: "), pmid, F.lit(", ")), F.lit("")), F.lit("and PMC: "), F.regexp_extract("pmcid", "[0-9]+", 0), F.lit("."))
    return _manifest(spark, d).select("pmcid", "version", I.normalize_pmcid(F.concat(F.lit(" pmc"), F.regexp_extract("pmcid", "[0-9]+", 0))).alias("pmc"), I.normalize_pmid(pmid).alias("pm"), F.array_join(I.biomedical_ids(printed), " ").alias("ids"))


# --- years and numbers ----------------------------------------------------------------------------------------------


@q(r"""SELECT ext_id, CAST(coalesce(nullif(regexp_extract(raw, '\(((?:1[5-9]|20)[0-9]{2})[a-z]?\)', 1), ''), nullif(regexp_extract(raw, '(?:^|[^0-9–-])((?:1[5-9]|20)[0-9]{2})[a-z]?(?:[^0-9–-]|$)', 1), '')) AS INTEGER) AS year,
              CAST(nullif(regexp_extract(raw, '(?:^|[^0-9])([12][0-9]{3})(?:[^0-9]|$)', 1), '') AS INTEGER) AS date_year,
              year(loaded_at) AS pdf_year,
              regexp_matches(raw, '(?:^|[^0-9])(?:1[5-9]|20)[0-9]{2}(?:[^0-9]|$)') OR regexp_matches(raw, '(?i)\bn\.\s?d\.|in press|forthcoming|to appear') OR regexp_matches(raw, '10\.[0-9]{4,9}/[^\s"<>]+') OR regexp_matches(raw, '(?i)\barxiv\b') OR regexp_matches(raw, '(?i)https?://') AS evidence
       FROM extracted_refs WHERE raw IS NOT NULL""")
def entry_years(spark, d):
    """Years of entries by the rule of printed entries and of dates, of a file's date, and whether an entry has evidence of being one."""
    e = _refs(spark, d, "raw", "loaded_at").filter("raw IS NOT NULL")
    stamp = F.concat(F.lit("D:"), F.date_format("loaded_at", "yyyyMMddHHmmss"))
    return e.select("ext_id", I.find_year("raw").alias("year"), I.year_from_date("raw").alias("date_year"), I.year_from_pdf_date(stamp).cast("bigint").alias("pdf_year"), I.has_reference_evidence("raw").alias("evidence"))


_PAGE = r"([A-Za-z]?[0-9]+)\s*[-–—]+\s*([A-Za-z]?[0-9]+)"
_ORDERS = (
    rf"(?i)([0-9]+)\s*\(([0-9]+(?:[-–/][0-9]+)?)\)\s*[:,;]\s*(?:pp?\.?\s*)?{_PAGE}", rf"(?i)vol(?:ume|\.)?\s*([0-9]+)\s*[,/ ]\s*(?:no\.?|issue)?\s*([0-9]+)\s*,\s*(?:pp?\.?\s*){_PAGE}", rf"(?i)\bvol(?:ume|\.)?\s*([0-9]+)()[^0-9]+(?:pp?\.?\s*){_PAGE}",
    rf"([0-9]+)()\s*[:]\s*{_PAGE}", rf"(?i)([0-9]+)()\s*,\s*(?:pp?\.?\s*){_PAGE}", r"([0-9]+)\s*\(([0-9]+)\)()()", rf"(?i)()()pp?\.?\s*{_PAGE}",
)


def _order(g: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}') THEN nullif(regexp_extract(raw, '{p}', {g}), '')" for p in _ORDERS) + " END"


@q(f"""SELECT ext_id, {_order(1)} AS volume, {_order(2)} AS issue, {_order(3)} || coalesce('–' || {_order(4)}, '') AS pages FROM extracted_refs WHERE raw IS NOT NULL""")
def entry_numbers(spark, d):
    """Volume, issue and pages of entries."""
    e = _refs(spark, d, "raw").filter("raw IS NOT NULL").select("ext_id", I.parse_numbers("raw").alias("n"))
    return e.select("ext_id", "n.volume", "n.issue", "n.pages")


@q(r"""SELECT ext_id, nullif(regexp_replace(regexp_extract(raw, '(?i)https?://[^\s<>"]+'), '[.,;:)\]}''”’]+$', ''), '') AS url, regexp_replace(coalesce(label, '') || ' ' || raw, '^\s*(?:\[[^\]]{1,12}\]|\([0-9]{1,4}\)|[0-9]{1,4}\.\s)\s*', '') AS bare,
              regexp_replace(raw, '(?is)\bcite\s+this.*$', '') AS reference FROM extracted_refs WHERE raw IS NOT NULL""")
def entry_texts(spark, d):
    """Address of each entry, and its text without label and without a note on how to cite it."""
    e = _refs(spark, d, "raw", "label").filter("raw IS NOT NULL")
    return e.select("ext_id", I.find_url("raw").alias("url"), I.strip_label(F.concat(F.coalesce("label", F.lit("")), F.lit(" "), "raw")).alias("bare"), C.reference_text(F.col("raw")).alias("reference"))


# --- names ----------------------------------------------------------------------------------------------------------

_LAST = r"CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) ELSE list_extract(regexp_split_to_array(t, '\s+'), -1) END"


@q(rf"""SELECT ref_id, lower({_LAST}) AS surname, upper(left(s, 1)) || substr(s, 2) || CAST(year AS VARCHAR) AS label,
               CASE WHEN regexp_matches(c, '\p{{L}}') THEN lower(regexp_replace(CASE WHEN contains(c, ',') THEN trim(split_part(c, ',', 1)) ELSE list_extract(string_split(c, ' '), -1) END, '[^\p{{L}}-]', '', 'g')) || '|'
                 || lower(substr(regexp_replace(CASE WHEN contains(c, ',') THEN trim(list_extract(string_split(c, ','), -1)) ELSE list_extract(string_split(c, ' '), 1) END, '[^\p{{L}}]', '', 'g'), 1, 1)) END AS person,
               CASE WHEN contains(t, ',') THEN trim(split_part(t, ',', 1)) ELSE regexp_extract(t, '((?:(?i:van der|van|von|de la|de|del|di|da|le|la|ten|al)\s+)?[^\s]+)$', 1) END AS family
        FROM (SELECT *, trim(authors[1]) AS t, trim(regexp_replace(authors[1], '\s+', ' ', 'g')) AS c, lower(trim(regexp_extract(authors[1], '[A-Za-z]+'))) AS s FROM source_refs WHERE regexp_matches(authors[1], '[^\s]'))""".replace("upper(left(s, 1)) || substr(s, 2) || CAST(year AS VARCHAR) AS label,", ""))
def author_names(spark, d):
    """Surname, key and family name with its particle of each first author."""
    a = F.get("authors", F.lit(0))
    e = table(spark, d, "source_refs").filter(a.rlike(r"\S"))
    return e.select("ref_id", I.surname(a).alias("surname"), E.person_key(a).alias("person"), C.family_of(a).alias("family"))


@q(r"""SELECT creator_id, list_filter(list_transform(regexp_split_to_array(n, '\s*(?:;|,|\band\b|&|\n)\s*'), lambda p: trim(regexp_replace(p, '[0-9*†‡§¶⁰¹²³⁴⁵⁶⁷⁸⁹]+', '', 'g'))), lambda p: p <> '') AS parts,
              lower(trim(n)) = '' OR lower(trim(n)) IN ('admin', 'administrator', 'user', 'author', 'owner', 'unknown', 'anonymous', 'root', 'guest', 'none') OR regexp_matches(lower(trim(n)), '^[a-z]+[0-9]+$') OR NOT regexp_matches(lower(trim(n)), '\p{L}{2}') AS generic
       FROM (SELECT creator_id, coalesce(first_name, '') || '; ' || coalesce(last_name, '') || ' & ' || coalesce(name, '') AS n FROM creators WHERE NOT regexp_matches(coalesce(first_name, '') || coalesce(last_name, '') || coalesce(name, ''), ',\s*(?:Jr|Sr|II|III|PhD|MD)\b'))""".replace(" WHERE NOT regexp_matches(coalesce(first_name, '') || coalesce(last_name, '') || coalesce(name, ''), ',\\s*(?:Jr|Sr|II|III|PhD|MD)\\b')", "").replace("regexp_split_to_array(n, '\\s*(?:;|,|\\band\\b|&|\\n)\\s*')", "regexp_split_to_array(regexp_replace(n, ',(\\s*(?:Jr|Sr|II|III|PhD|MD)\\b)', '\x01\\1', 'g'), '\\s*(?:;|,|\\band\\b|&|\\n)\\s*')").replace("lambda p: trim(regexp_replace(p,", "lambda p: trim(regexp_replace(replace(p, '\x01', ','),"))
def author_lists(spark, d):
    """Printed creators as lists of names, and whether the line is a login or placeholder."""
    n = F.concat(F.coalesce("first_name", F.lit("")), F.lit("; "), F.coalesce("last_name", F.lit("")), F.lit(" & "), F.coalesce("name", F.lit("")))
    return table(spark, d, "creators").select("creator_id", M.split_author_names(n).alias("parts"), M.author_is_generic(n).alias("generic"))


@q(r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace('Keywords: ' || title, '^(?i:\s*(?:key\s?words?|index terms)\s*[:—–-]\s*)', ''), '\s*[;,·•]\s*'), lambda p: regexp_replace(trim(p), '\.$', '')), lambda p: p <> '') AS words FROM documents WHERE title IS NOT NULL""")
def keyword_lists(spark, d):
    """Keyword lines as lists."""
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", M.split_keywords(F.concat(F.lit("Keywords: "), "title")).alias("words"))


# --- addresses ------------------------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(u, '^https?://([^/:?#]+)', 1))"
_TWO = "list_extract(string_split(h, '.'), -2) || '.' || list_extract(string_split(h, '.'), -1)"
_SUFFIXES = ", ".join(f"'{s}'" for s in sorted(W.SUFFIXES))


@q(rf"""SELECT pmcid, version, h AS host, CASE WHEN {_TWO} IN ({_SUFFIXES}) THEN {_TWO} ELSE list_extract(string_split(h, '.'), -1) END AS suffix,
               CASE WHEN {_TWO} IN ({_SUFFIXES}) THEN CASE WHEN len(string_split(h, '.')) >= 3 THEN list_extract(string_split(h, '.'), -3) || '.' || {_TWO} END WHEN len(string_split(h, '.')) >= 2 THEN {_TWO} END AS domain,
               CASE WHEN h = 'blocked.example' OR ends_with(h, '.blocked.example') THEN 'block' WHEN h = 'example' OR ends_with(h, '.example') OR h = 'org' OR ends_with(h, '.org') THEN 'allow' ELSE 'block' END AS decision,
               CASE WHEN regexp_matches(p, '\.pdf$') OR regexp_matches(p, '/pdf(?:/|$)|/pdfdirect/|/epdf/') OR regexp_matches(p, '^/pdf/[0-9]{{4}}\.[0-9]+') THEN 'likely' WHEN contains(p, 'fulltext') OR contains(p, 'download') THEN 'possible' ELSE 'no' END AS verdict
        FROM (SELECT pmcid, version, {_HOST} AS h, lower(regexp_extract(u, '^https?://[^/?#]+([^?#]*)', 1)) AS p FROM (SELECT pmcid, version, pdf_url AS u FROM {MANIFEST} WHERE pdf_url IS NOT NULL))""")
def address_parts(spark, d):
    """Host, public suffix, registrable domain, decision by domain lists and PDF verdict of the manifest's addresses."""
    h = F.lower(F.parse_url("pdf_url", F.lit("HOST")))
    m = _manifest(spark, d).filter("pdf_url IS NOT NULL")
    return m.select("pmcid", "version", h.alias("host"), W.public_suffix(h).alias("suffix"), W.registrable_domain(h).alias("domain"), W.host_decision(h, ["blocked.example"], ["example", "org"]).alias("decision"), W.classify_pdf_url(F.col("pdf_url"))["verdict"].alias("verdict"))


@q(rf"""SELECT pmcid, version, 'https://resolver.example/get?url_ver=Z39.88-2004&rft_val_fmt=' || e('info:ofi/fmt:kev:mtx:journal') || CASE WHEN title <> '' THEN '&rft.atitle=' || e(title) ELSE '' END || coalesce('&rft.date=' || CAST(year AS VARCHAR), '')
               || coalesce('&rft_id=' || e('info:doi/' || doi), '') || CASE WHEN journal <> '' THEN '&rft.jtitle=' || e(journal) ELSE '' END AS url FROM {MANIFEST}""".replace("|| e(", "|| url_encode("))
def openurls(spark, d):
    """Resolver addresses of the manifest's items; letters beyond ASCII as UTF-8 escapes."""
    return _manifest(spark, d).select("pmcid", "version", W.build_openurl(F.lit("https://resolver.example/get"), F.col("title"), F.lit(None).cast("string"), F.col("year"), F.col("doi"), F.col("journal")).alias("url"))


@q(rf"""SELECT pmcid, version, 'attachment' AS kind, pmcid || '.pdf' AS filename, lower(article_type) AS mime, pdf_url AS next_url, {_HOST} AS domain, CAST(year AS BIGINT) * 1000 AS expires, pmcid AS name,
               CASE WHEN lower(article_type) IN ('application/pdf', 'application/x-pdf') OR ends_with(lower(pmcid || '.pdf'), '.pdf') THEN 'likely' END AS verdict, coalesce(CAST(year AS BIGINT) * 1000 > 2015000, false) AS live
        FROM (SELECT *, pdf_url AS u FROM {MANIFEST} WHERE pdf_url IS NOT NULL AND year IS NOT NULL AND article_type IS NOT NULL)""")
def response_headers(spark, d):
    """Headers and cookies that answer the manifest's addresses, written out and read again."""
    m = _manifest(spark, d).filter("pdf_url IS NOT NULL AND year IS NOT NULL AND article_type IS NOT NULL")
    host = F.lower(F.parse_url("pdf_url", F.lit("HOST")))
    mime = F.concat(F.upper("article_type"), F.lit(" ; charset=utf-8"))
    disposition = F.concat(F.lit('Attachment; filename="'), "pmcid", F.lit('.pdf"'))
    link = F.concat(F.lit("<"), "pdf_url", F.lit('>; rel="next", <https://x.example/>; rel="prev"'))
    line = F.concat(F.lit("."), host, F.lit("\tTRUE\t/\tFALSE\t"), (F.col("year").cast("bigint") * 1000).cast("string"), F.lit("\t"), "pmcid", F.lit("\tv"))
    x = m.select("pmcid", "version", "pdf_url", mime.alias("m"), disposition.alias("d"), W.link_header(link).alias("l"), W.netscape_cookie(line).alias("c"), host.alias("h"))
    fits = W.cookie_matches(F.col("c"), F.concat(F.lit("www."), "h"), F.lit("/a"), F.lit(False))
    return x.filter(fits).select(
        "pmcid", "version", W.content_disposition("d")["kind"].alias("kind"), W.content_disposition("d")["filename"].alias("filename"), W.mime_type("m").alias("mime"), F.get("l", F.lit(0))["url"].alias("next_url"), "c.domain", "c.expires", "c.name",
        F.when(W.classify_pdf_response(F.col("pdf_url"), F.col("m"), F.col("d")) == "likely", "likely").alias("verdict"), (F.size(W.live_cookies(F.array("c"), F.lit(2015000))) == 1).alias("live"),
    )


@q(rf"""SELECT pmcid, version, doi, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, pdf_url AS pdf FROM (SELECT pmcid, version, lower(doi) AS doi, title AS t, pdf_url FROM {MANIFEST} WHERE doi IS NOT NULL AND title IS NOT NULL AND pdf_url IS NOT NULL)""")
def page_inspection(spark, d):
    """Landing pages of the manifest's items, written out and inspected: declared DOI, visible text, PDF link."""
    m = _manifest(spark, d).filter("doi IS NOT NULL AND title IS NOT NULL AND pdf_url IS NOT NULL")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    page = F.concat(F.lit('<html><head><script>var a = "<b>";</script><meta name="citation_doi" content="https://doi.org/'), escaped(F.col("doi")), F.lit('"><meta name="citation_pdf_url" content="'), escaped(F.col("pdf_url")), F.lit('"></head><body><h1>'), escaped(F.col("title")), F.lit("</h1></body></html>"))
    x = m.select("pmcid", "version", "pdf_url", page.alias("html"))
    seen = W.inspect_page(F.lit("https://journal.example/article"), F.col("html"))
    return x.select("pmcid", "version", seen["primary_doi"].alias("doi"), W.html_text("html").alias("text"), F.get(seen["pdfs"], F.lit(0))["url"].alias("pdf"))


# --- texts ----------------------------------------------------------------------------------------------------------


@q(r"""SELECT count_if(regexp_matches(t, '^(?i:(?:page\s+)?[-–—]?\s*[0-9]{1,4}\s*[-–—]?(?:\s*(?:of|/)\s*[0-9]{1,4})?)$') OR (t <> '' AND regexp_matches(t, '^(?i:(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))$'))) AS page_numbers,
              count_if(ord AND regexp_matches(line, '[=<>≤≥≈≡∈∑∏∫√±×·∂∇∞→↦⊂⊆∪∩∀∃^_{}]|\p{Sm}')) AS math_lines,
              count_if(regexp_matches(t, '←|:=|▷|⊳') OR regexp_matches(t, '^(?i:(?:[0-9]+\s*[:.]?\s*)?(?:if\b.*\bthen|else\b|end\b|for\b.*\bdo|for each\b|foreach\b|while\b.*\bdo|repeat\b|until\b|return\b|require:?|ensure:?|input:|output:|procedure\b|function\b))')) AS algorithm_lines,
              count_if(length(s) > 0 AND length(s) - length(regexp_replace(s, '[^\p{L}]', '', 'g')) >= length(regexp_replace(s, '[^\p{L}]', '', 'g'))) AS heavy
       FROM (SELECT *, len(list_filter(regexp_extract_all(line, '[^\s]+'), lambda w: regexp_matches(w, '^\p{L}{3,}[.,;:]?$'))) <= 2 AS ord, trim(line, ' ') AS t, regexp_replace(line, '\s', '', 'g') AS s
             FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks) WHERE text IS NOT NULL))""")
def line_kinds(spark, d):
    """Lines that are page numbers, mathematics, pseudo-code or hold few letters."""
    lines = table(spark, d, "search_chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"]).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.agg(F.count_if(X.is_page_number("line")).alias("page_numbers"), F.count_if(X.is_math_line("line")).alias("math_lines"), F.count_if(X.is_algorithm_line("line")).alias("algorithm_lines"), F.count_if(X.is_math_heavy("line")).alias("heavy"))


@q(rf"""SELECT ext_id, lower(regexp_replace(raw, '\s', '', 'g')) AS squashed, regexp_replace(raw, '(\p{{L}})-\s+(\p{{L}})', '\1\2', 'g') AS mended, CASE WHEN regexp_full_match(volume, '[0-9+\-=()ni]+') THEN translate(volume, '0123456789+-=()ni', '⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ') END AS raised,
               CASE WHEN len(l) >= 2 THEN len(list_intersect(l, {_put(WORDS, 'raw')})) / len(l) END AS overlap, contains(lower(regexp_replace(raw, '\s', '', 'g')), lower(doi)) AS printed
        FROM (SELECT *, list_distinct(list_filter({_put(WORDS, "coalesce(title, '')")}, lambda w: length(w) >= 4)) AS l FROM extracted_refs WHERE raw IS NOT NULL)""")
def entry_forms(spark, d):
    """Entries without white space and with mended breaks, raised volumes, the title's share in the entry, whether the DOI is printed."""
    e = _refs(spark, d, "raw", "volume", "title", "doi").filter("raw IS NOT NULL")
    return e.select("ext_id", X.squash("raw").alias("squashed"), X.join_break_hyphens("raw").alias("mended"), X.script_form("volume", True).alias("raised"), X.title_overlap(F.coalesce("title", F.lit("")), F.col("raw")).alias("overlap"), E.doi_is_printed(F.col("doi"), X.squash("raw")).alias("printed"))


@q(r"""SELECT doc_id, length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) AS line,
              len(list_filter(list_transform(list_filter(regexp_extract_all(text, '[^\s]+'), lambda w: regexp_matches(w, '\p{L}') AND NOT regexp_matches(w, '[=<>≤≥≈∈∑∏∫√±×∂∇∞→^_\\{}]') AND NOT regexp_matches(w, '^[b-hj-zB-HJ-Z]$')), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: w <> '')) AS words
       FROM documents WHERE text IS NOT NULL""")
def text_positions(spark, d):
    """Line of the middle character and number of words that word alignment compares."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", X.line_of_offset("text", F.floor(F.col("n_chars") / 2).cast("int")).cast("bigint").alias("line"), F.size(X.alignment_words("text")).cast("bigint").alias("words"))


@q(r"""SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM embeddings)""")
def unit_vectors(spark, d):
    """Squared length and first element of every vector brought to unit length."""
    u = table(spark, d, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


# --- pairs ----------------------------------------------------------------------------------------------------------

_PAIRS = rf"""(SELECT s.ref_id, e.ext_id, s.title AS a, e.title AS b, s.authors AS sa, e.authors AS ea, e.raw, e.venue FROM source_refs s JOIN extracted_refs e ON lower(s.doi) = lower(e.doi))"""
_NORM = rf"trim(regexp_replace(lower({{0}}), {ALNUM}, ' ', 'g'))"
_SET = f"list_distinct({WORDS})"
_PERSON = r"list_filter(list_transform({0}, lambda n: CASE WHEN regexp_matches(n, '\p{L}') THEN lower(regexp_replace(CASE WHEN contains(n, ',') THEN trim(split_part(n, ',', 1)) ELSE list_extract(string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ' '), -1) END, '[^\p{L}-]', '', 'g')) || '|' || lower(substr(regexp_replace(CASE WHEN contains(n, ',') THEN trim(list_extract(string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ','), -1)) ELSE list_extract(string_split(trim(regexp_replace(n, '\s+', ' ', 'g')), ' '), 1) END, '[^\p{L}]', '', 'g'), 1, 1)) END), lambda k: k IS NOT NULL)"


@q(rf"""SELECT ref_id, ext_id, CASE WHEN a IS NULL AND b IS NULL THEN true ELSE coalesce({_put(_NORM, 'a')} = {_put(_NORM, 'b')}, false) END AS same_title,
               CASE WHEN a IS NULL AND b IS NULL THEN true ELSE coalesce({_put(_NORM, 'a')} = {_put(_NORM, 'b')}, false) OR coalesce(CASE WHEN len({_put(_SET, 'a')}) = 0 OR len({_put(_SET, 'b')}) = 0 THEN false ELSE len(list_intersect({_put(_SET, 'a')}, {_put(_SET, 'b')})) / len(list_distinct(list_concat({_put(_SET, 'a')}, {_put(_SET, 'b')}))) >= 0.9 END, false) END AS near_title,
               coalesce(len(list_filter(regexp_extract_all(a, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(b, '[0-9]+'), x))) > 0 AND len(list_filter(regexp_extract_all(b, '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(a, '[0-9]+'), x))) > 0, false) AS digits_conflict,
               (SELECT coalesce(sum(least(x.n, y.n)), 0)::BIGINT FROM (SELECT k, count(*) AS n FROM unnest({_put(_PERSON, 'sa')}) u(k) GROUP BY k) x JOIN (SELECT k, count(*) AS n FROM unnest({_put(_PERSON, 'ea')}) u(k) GROUP BY k) y USING (k)) AS shared_authors,
               coalesce(len(list_filter(list_filter({_put(WORDS, 'venue')}, lambda w: length(w) >= 4 AND NOT list_contains({_put(WORDS, "coalesce(b, '')")}, w)), lambda w: list_contains({_put(WORDS, 'raw')}, w))) > 0, false) AS venue_printed
        FROM {_PAIRS}""")
def pair_agreements(spark, d):
    """How source and extracted entries of one DOI agree in title, digits, authors and printed venue."""
    s = table(spark, d, "source_refs").select("ref_id", F.lower("doi").alias("doi"), F.col("title").alias("a"), F.col("authors").alias("sa"))
    e = table(spark, d, "extracted_refs").select("ext_id", F.lower("doi").alias("doi"), F.col("title").alias("b"), F.col("authors").alias("ea"), "raw", "venue")
    x = s.join(e, "doi")
    return x.select(
        "ref_id", "ext_id", E.title_equal(F.col("a"), F.col("b")).alias("same_title"), E.paper_title_matches(F.col("a"), F.col("b")).alias("near_title"), F.coalesce(X.digits_conflict(F.col("a"), F.col("b")), F.lit(False)).alias("digits_conflict"),
        F.greatest(E.author_matches(F.col("sa"), F.col("ea")), F.lit(0)).cast("bigint").alias("shared_authors"), F.coalesce(C.venue_in_entry(F.col("venue"), F.col("raw"), F.coalesce("b", F.lit(""))), F.lit(False)).alias("venue_printed"),
    )


@q(rf"""SELECT paper_id, t, count(*) AS n FROM (SELECT paper_id, doi, {_put(_NORM, 'title')} AS t FROM source_refs WHERE title IS NOT NULL) GROUP BY paper_id, t HAVING count(*) >= 2 AND count(DISTINCT doi) <= 1""")
def repeated_entries(spark, d):
    """Entries of one paper with one title that no two DOIs tell apart."""
    t = table(spark, d, "source_refs").filter("title IS NOT NULL").select("paper_id", "doi", X.normalize_title("title").alias("t"))
    return E.duplicate_groups(t, "paper_id", "t", "doi")


@q("""SELECT doc, count(DISTINCT idx) AS targets, count(DISTINCT CASE WHEN cited THEN idx END) AS correct, count(DISTINCT CASE WHEN cited THEN k END) AS keys_hit, any_value(kc) AS keys_cited
      FROM (SELECT m.run_key AS doc, m.idx, e.doi AS k, e.doi IS NOT NULL AND e.year >= 2000 IS TRUE AND c.k IS NOT NULL AS cited, coalesce(kc, 0) AS kc
            FROM (SELECT DISTINCT run_key, idx FROM extracted_refs) m LEFT JOIN extracted_refs e ON e.run_key = m.run_key AND e.idx = m.idx
            LEFT JOIN (SELECT DISTINCT run_key, doi AS k FROM extracted_refs WHERE doi IS NOT NULL AND year >= 2000) c ON c.run_key = m.run_key AND c.k = e.doi
            LEFT JOIN (SELECT run_key, count(DISTINCT doi) AS kc FROM extracted_refs WHERE doi IS NOT NULL AND year >= 2000 GROUP BY run_key) z ON z.run_key = m.run_key) GROUP BY doc""".replace("e.doi IS NOT NULL AND e.year >= 2000 IS TRUE AND c.k IS NOT NULL", "c.k IS NOT NULL"))
def marker_rates(spark, d):
    """Citation targets of every run that resolve to a cited key."""
    e = table(spark, d, "extracted_refs").select(F.col("run_key").alias("doc"), F.col("idx").alias("e_idx"), F.col("doi").alias("key"), "year")
    markers = e.select("doc", F.array("e_idx").alias("targets"))
    return E.marker_correctness(markers, e.select("doc", "e_idx", "key"), e.filter("key IS NOT NULL AND year >= 2000").select("doc", "key"))


# --- ledger and index -----------------------------------------------------------------------------------------------

_RUNS = "(SELECT DISTINCT ON (run_key) * FROM runs)"


@q(rf"""SELECT run_key, sha256(config_digest || ':pages=1-' || least(20, schema_version)) AS part, sha256('backend=' || backend_name || chr(10) || 'version=' || backend_version || chr(10)) AS config, left(hash, 2) AS prefix,
               hash || '/' || backend_name || '-' || left(config_digest, 8) || '/p1-f0.png' AS figure FROM {_RUNS} WHERE backend_name IS NOT NULL AND backend_version IS NOT NULL""")
def run_digests(spark, d):
    """Identities of runs over a part of the pages and of their settings, and where they keep a figure."""
    r = table(spark, d, "runs").dropDuplicates(["run_key"]).filter("backend_name IS NOT NULL AND backend_version IS NOT NULL")
    pages = L.page_range(F.lit(1), F.lit(20), F.col("schema_version"))
    x = L.with_prefix(r).withColumn("pages", pages)
    figure = files.figure_path(F.col("hash"), F.col("backend_name"), F.col("config_digest"), F.lit(1), F.lit(0), F.lit("image/png"))
    return x.select("run_key", L.sub_range_digest(F.col("config_digest"), F.col("pages.first"), F.col("pages.last")).alias("part"), L.config_digest(F.create_map(F.lit("version"), "backend_version", F.lit("backend"), "backend_name")).alias("config"), F.col("hash_prefix").alias("prefix"), figure.alias("figure"))


@q(rf"""SELECT hash, run_key, status FROM {_RUNS} WHERE starts_with(hash, 'a') ORDER BY finished_at DESC NULLS LAST, run_key DESC LIMIT 1""")
def run_of_prefix(spark, d):
    """The latest run of the hashes that begin with a."""
    return L.latest_for_prefix(table(spark, d, "runs").dropDuplicates(["run_key"]), "a").select("hash", "run_key", "status")


@q(rf"""SELECT r.run_key, coalesce(n, 0) AS refs, first_raw, CASE WHEN r.status = 'complete' THEN r.timings.parse_ms + 1 ELSE r.timings.parse_ms END AS parse_ms
        FROM {_RUNS} r LEFT JOIN (SELECT run_key, count(*) AS n, arg_min(coalesce(raw, ''), idx) AS first_raw FROM extracted_refs GROUP BY run_key) e ON e.run_key = r.run_key""")
def run_results(spark, d):
    """Runs with their references nested, and with the timings of those that have new ones."""
    r = table(spark, d, "runs").dropDuplicates(["run_key"])
    e = table(spark, d, "extracted_refs").select("run_key", "idx", F.coalesce("raw", F.lit("")).alias("raw"))
    none = e.limit(0).select("run_key", F.col("idx").alias("page"), F.col("idx").alias("offset"))
    new = r.filter("status = 'complete'").select("run_key", F.col("timings").withField("parse_ms", F.col("timings.parse_ms") + 1).alias("timings"))
    x = L.load_result(L.update_timings(r, new), none.select("run_key", "page"), e, none)
    return x.select("run_key", F.greatest(F.size("references"), F.lit(0)).cast("bigint").alias("refs"), F.get("references", F.lit(0))["raw"].alias("first_raw"), F.col("timings.parse_ms").alias("parse_ms"))


_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM search_chunks)"


@q(rf"""SELECT doc_hash, left(string_agg('[page ' || page || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY page, idx, coalesce(text, '')), 4000) AS context FROM {_CHUNKS} GROUP BY doc_hash""")
def document_contexts(spark, d):
    """The opening of every document, page by page."""
    return L.document_context(table(spark, d, "search_chunks").dropDuplicates(["chunk_id"]), 4000)


@q(rf"""SELECT doc_hash, pages, scanned, unmapped, empty, CASE WHEN unmapped > 0 THEN 'second' WHEN scanned > 0 THEN 'ocr' ELSE 'first' END AS route FROM (
          SELECT doc_hash, count(*) AS pages, count_if(length(regexp_replace(t, '\s', '', 'g')) < 20) AS scanned, count_if(length(t) > 0 AND (length(t) - length(replace(t, chr(65533), ''))) * 100 >= length(t)) AS unmapped, count_if(trim(t, ' ') = '') AS empty
          FROM (SELECT *, coalesce(text, '') AS t FROM {_CHUNKS}) GROUP BY doc_hash)""")
def document_routes(spark, d):
    """Which extractor each document goes to."""
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"]).withColumn("warnings", F.array().cast("array<string>")).withColumn("raster_share", F.lit(1.0))
    return L.assess(c).select("doc_hash", "pages", "scanned", "unmapped", "empty", "route")


@q(rf"""WITH p AS (SELECT doc_hash, page, length(string_agg(replace(coalesce(text, ''), chr(65533), ''), '')) AS l, length(coalesce(arg_min(replace(coalesce(text, ''), chr(65533), ''), (idx, chunk_id)), '')) AS c FROM {_CHUNKS} GROUP BY doc_hash, page)
        SELECT doc_hash, CASE WHEN bad IS NULL THEN 'candidate' ELSE 'native' END AS use, bad AS reason FROM (SELECT doc_hash, CASE WHEN count_if(c * 2 < l) > 0 THEN 'text lost' END AS bad FROM p GROUP BY doc_hash)""")
def preferred_results(spark, d):
    """Whether a result that keeps only the first chunk of each page may replace the whole one."""
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"]).withColumn("text", F.coalesce("text", F.lit("")))
    pages = c.groupBy("doc_hash", "page").agg(F.array_join(F.collect_list("text"), "").alias("text"), F.min_by("text", F.struct("idx", "chunk_id")).alias("first")).withColumn("status", F.lit("complete"))
    return L.prefer_candidate(pages, pages.select("doc_hash", "page", "status", F.col("first").alias("text")))


_FP = rf"""SELECT doc_hash, sha256(length(any_value(run_key)) || ':' || any_value(run_key) || length(coalesce(any_value(t), '')) || ':' || coalesce(any_value(t), '') || string_agg(length(coalesce(text, '')) || ':' || coalesce(text, ''), '' ORDER BY chunk_id)) AS fingerprint
           FROM (SELECT *, max(title) OVER (PARTITION BY doc_hash, run_key) AS t FROM {_CHUNKS} WHERE doc_hash IS NOT NULL) GROUP BY doc_hash, run_key"""


@q(rf"""SELECT doc_hash, fingerprint, starts_with(doc_hash, '0') AS replaced FROM ({_FP})""")
def index_updates(spark, d):
    """Fingerprints of the indexed runs; those of documents that begin with 0 were stale and have been replaced."""
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"]).filter("doc_hash IS NOT NULL")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"])
    now = c.groupBy("doc_hash", "run_key").agg(F.max("title").alias("t"), texts.alias("texts")).select("doc_hash", "run_key", S.run_fingerprint(F.col("run_key"), F.col("t"), F.col("texts")).alias("fingerprint"))
    old = now.withColumn("fingerprint", F.when(F.startswith("doc_hash", F.lit("0")), F.lit("old")).otherwise(F.col("fingerprint"))).withColumn("replaced", F.lit(False))
    stale = S.stale_documents(old, now).withColumn("replaced", F.lit(True))
    return S.upsert(old, stale, "run_key").select("doc_hash", "fingerprint", "replaced")


@q(r"""SELECT doc_id, nullif(trim(regexp_replace(title, '\s+', ' ', 'g')), '') AS abstract FROM documents WHERE title IS NOT NULL""")
def rebuilt_titles(spark, d):
    """Titles turned into word positions and back."""
    ws = X.tokens(F.col("title"))
    at = F.transform(F.array_distinct(ws), lambda w: F.struct(w.alias("key"), F.filter(F.sequence(F.lit(0), F.size(ws)), lambda i: F.get(ws, i) == w).alias("value")))
    return table(spark, d, "documents").filter("title IS NOT NULL").select("doc_id", F.trim(F.regexp_replace(R.reconstruct_abstract(F.map_from_entries(at)), r"\s+", " ")).alias("abstract"))


@q(r"""SELECT ref_id, list_filter([CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv https://arxiv.org/pdf/' || arxiv_id END, CASE WHEN doi IS NOT NULL THEN 'resolver https://resolver.example?id=doi:' || doi END], lambda x: x IS NOT NULL) AS places FROM source_refs""")
def full_text_places(spark, d):
    """Full-text addresses that follow from identifiers."""
    p = R.static_candidates(F.col("doi"), F.col("arxiv_id"), F.lit(None).cast("string"), "https://resolver.example")
    return table(spark, d, "source_refs").select("ref_id", F.transform(p, lambda x: F.concat_ws(" ", x["source"], x["url"])).alias("places"))


@q(r"""SELECT run_key, string_agg('[' || coalesce(label, CAST(idx + 1 AS VARCHAR)) || '] ' || raw, chr(10) ORDER BY idx) AS text FROM extracted_refs GROUP BY run_key""")
def reference_lists(spark, d):
    """Every run's references as plain text."""
    return files.plain_text_list(table(spark, d, "extracted_refs"), "run_key")


@q(r"""SELECT backend_name AS method, status AS outcome, count(*) AS n FROM (SELECT DISTINCT ON (run_key) * FROM runs) GROUP BY ALL""")
def attempt_outcomes(spark, d):
    """Attempts by method and outcome."""
    return C.outcome_counts(table(spark, d, "runs").dropDuplicates(["run_key"]).select(F.col("backend_name").alias("method"), F.col("status").alias("outcome")))
