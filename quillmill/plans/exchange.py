"""Queries that write the stored records in the formats of registries and bibliographies and read them again, with SQL that gives what must come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import web as W
from quillmill.operators import citations
from quillmill.operators import metadata as M
from quillmill.operators import search as S
from quillmill.plans.records import BARE, DOI
from quillmill.plans.registry import Registry
from quillmill.session import table
from quillmill.sources import latex
from quillmill.sources import registries as G

QUERIES = Registry()
q = QUERIES.query

_DOI = f"(SELECT {DOI.format('b')} FROM (SELECT {BARE.format('doi')} AS b))"
_TIDY = r"""trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ')"""
_MANIFEST = "(SELECT DISTINCT ON (pmcid, version) * FROM manifest_items)"
_FIELDS = ("title", "authors", "year", "venue", "doi", "source", "source_id")


def _truth(spark, d):
    return table(spark, d, "source_refs")


def _manifest(spark, d):
    return table(spark, d, "manifest_items").dropDuplicates(["pmcid", "version"])


def _pmc():
    return F.regexp_replace("pmcid", "^[A-Z]+", "PMC")


def _structs(names, f):
    return F.transform(names, f)


@q(f"""SELECT title, authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, kind AS venue, {_DOI} AS doi, 'openalex' AS source, 'W' || ref_id AS source_id, CASE WHEN doi IS NOT NULL THEN 'https://files.example/' || ref_id END AS place FROM source_refs""")
def openalex_records(spark, d):
    """Answers of one registry."""
    body = F.to_json(F.struct(F.array(F.struct(
        F.concat(F.lit("W"), "ref_id").alias("id"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.struct(F.struct(F.col("kind").alias("display_name")).alias("source")).alias("primary_location"),
        _structs("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.when(F.col("doi").isNotNull(), F.concat(F.lit("https://files.example/"), "ref_id")).alias("oa_url")).alias("open_access"),
    )).alias("results")))
    return G.openalex(_truth(spark, d).select(body.alias("body"))).select(*_FIELDS, F.get("candidates", F.lit(0))["url"].alias("place"))


@q(f"""SELECT {_TIDY.format('title')} AS title, authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, kind AS venue, {_DOI} AS doi, 'crossref' AS source, doi AS source_id, false AS requires_session FROM source_refs WHERE title IS NOT NULL""")
def crossref_records(spark, d):
    """Answers of another one, with markup in titles, group authors and licences."""
    body = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("doi").alias("DOI"), F.array(F.concat(F.lit("<i>"), F.col("title"), F.lit("</i>"))).alias("title"), _structs("authors", lambda a: F.struct(a.alias("name"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("issued"), F.array("kind").alias("container-title"),
        F.array(F.struct(F.lit("https://creativecommons.org/licenses/by/4.0/").alias("URL"), F.lit(0).alias("delay-in-days"))).alias("license"), F.array(F.struct(F.lit("https://files.example/a.pdf").alias("URL"), F.lit("application/pdf").alias("content-type"))).alias("link"),
    )).alias("items")).alias("message")))
    return G.crossref(_truth(spark, d).filter("title IS NOT NULL").select(body.alias("body"))).select(*_FIELDS, F.get("candidates", F.lit(0))["requires_session"].alias("requires_session"))


@q(f"""SELECT title, authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, kind AS venue, {_DOI} AS doi, 'semanticscholar' AS source, CAST(ref_id AS VARCHAR) AS source_id FROM source_refs""")
def scholar_records(spark, d):
    """Answers of a third one."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("ref_id").cast("string").alias("paperId"), "title", "year", F.col("kind").alias("venue"), _structs("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.struct(F.col("doi").alias("DOI"), F.col("arxiv_id").alias("ArXiv")).alias("externalIds"))).alias("data")))
    return G.semantic_scholar(_truth(spark, d).select(body.alias("body"))).select(*_FIELDS)


@q(f"""SELECT regexp_replace({_TIDY.format('title')}, '\\.$', '') AS title, ['A One', 'B Two'] AS authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, journal AS venue, {_DOI} AS doi, 'pmc' AS source, pmcid AS source_id, regexp_replace(pmcid, '^[A-Z]+', 'PMC') AS pmcid, nullif(regexp_extract(CAST(pmid AS VARCHAR), '^[0-9]{{1,9}}$'), '') AS pmid FROM {_MANIFEST} WHERE title IS NOT NULL""")
def europe_pmc_records(spark, d):
    """Answers of a biomedical registry."""
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("pmcid").alias("id"), F.col("pmid").cast("string").alias("pmid"), _pmc().alias("pmcid"), "doi", "title", F.lit("A One, B Two.").alias("authorString"), F.col("journal").alias("journalTitle"), F.col("year").cast("string").alias("pubYear"))).alias("result")).alias("resultList")))
    return G.europe_pmc(_manifest(spark, d).filter("title IS NOT NULL").select(body.alias("body"))).select(*_FIELDS, "pmcid", "pmid")


@q(f"""SELECT regexp_replace({_TIDY.format('title')}, '\\.$', '') AS title, ['A One'] AS authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, journal AS venue, {_DOI} AS doi, 'pmc' AS source, CAST(pmid AS VARCHAR) AS source_id, regexp_replace(pmcid, '^[A-Z]+', 'PMC') AS pmcid FROM {_MANIFEST} WHERE title IS NOT NULL AND pmid IS NOT NULL""")
def pubmed_records(spark, d):
    """Summaries keyed by id, in the order of their id list."""
    pmid = F.col("pmid").cast("string")
    summary = F.struct(pmid.alias("uid"), "title", F.concat(F.col("year").cast("string"), F.lit(" Jan 1")).alias("pubdate"), F.col("journal").alias("fulljournalname"), F.array(F.struct(F.lit("A One").alias("name"))).alias("authors"), F.array(F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value")), F.struct(F.lit("pmc").alias("idtype"), _pmc().alias("value"))).alias("articleids"))
    body = F.concat(F.lit('{"result":{"uids":["'), pmid, F.lit('"],"'), pmid, F.lit('":'), F.to_json(summary), F.lit("}}"))
    return G.pubmed_summary(_manifest(spark, d).filter("title IS NOT NULL AND pmid IS NOT NULL").select(body.alias("body"))).select(*_FIELDS, "pmcid")


@q(f"""SELECT CAST(pmid AS VARCHAR) AS id FROM {_MANIFEST} WHERE pmid IS NOT NULL""")
def search_answer_ids(spark, d):
    """Ids of search answers."""
    body = F.to_json(F.struct(F.struct(F.array(F.col("pmid").cast("string")).alias("idlist")).alias("esearchresult")))
    return G.search_ids(_manifest(spark, d).filter("pmid IS NOT NULL").select(body.alias("body")))


@q(f"""SELECT {_DOI} AS doi, pdf_url AS url, true AS is_best FROM {_MANIFEST} WHERE pdf_url IS NOT NULL UNION ALL SELECT {_DOI}, 'https://land.example/' || pmcid, false FROM {_MANIFEST} WHERE pdf_url IS NOT NULL""")
def open_copies(spark, d):
    """Open copies of documents, PDFs before landing pages."""
    none = F.lit(None).cast("string")
    best = F.struct(F.concat(F.lit("https://land.example/"), "pmcid").alias("url"), F.col("pdf_url").alias("url_for_pdf"))
    body = F.to_json(F.struct("doi", best.alias("best_oa_location"), F.array(best, F.struct(F.concat(F.lit("https://land.example/"), "pmcid").alias("url"), none.alias("url_for_pdf"))).alias("oa_locations")))
    return G.unpaywall(_manifest(spark, d).filter("pdf_url IS NOT NULL").select(body.alias("body")))


@q(f"""SELECT 'K' || ref_id AS source_id, nullif(title, '') AS title, coalesce(authors, []) AS authors, CASE WHEN year BETWEEN 1000 AND 2999 THEN year END AS year, 'library' AS source, kind AS venue, {_DOI} AS doi, CAST(ref_id AS VARCHAR) AS pmid FROM source_refs""")
def library_records(spark, d):
    """Items of a reference manager, identifiers in the notes field."""
    data = F.struct("title", F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("date"), F.col("kind").alias("publicationTitle"), F.concat(F.coalesce(F.concat(F.lit("DOI: "), "doi", F.lit("\n")), F.lit("")), F.lit("PMID: "), F.col("ref_id").cast("string"), F.lit("\nPMID: 1")).alias("extra"), F.concat(_structs(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.lit("author").alias("creatorType"), a.alias("name"))), F.array(F.struct(F.lit("editor").alias("creatorType"), F.lit("E").alias("name")))).alias("creators"))
    body = F.to_json(F.array(F.struct(F.concat(F.lit("K"), "ref_id").alias("key"), F.lit(1).alias("version"), data.alias("data"))))
    return G.item_record(G.library_items(_truth(spark, d).select(body.alias("body")))).select("source_id", "title", "authors", "year", "source", "venue", "doi", "pmid")


# Titles and names are written as hexadecimal digits: the formats themselves are the subject, over all rows; escapes are covered by the tests.
_NAMES = "list_filter(list_transform(coalesce(authors, []), lambda a: hex(a)), lambda a: a <> '')"


def _hexed(t):
    return t.select("ref_id", F.hex("title").alias("title"), F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.hex(a)), lambda a: a != "").alias("authors"), "year", "doi")


@q(rf"""SELECT 'k' || ref_id AS key, hex(title) AS title, {_NAMES} AS authors, CASE WHEN year BETWEEN 1500 AND 2099 THEN year END AS year, lower(doi) AS doi FROM source_refs""")
def bibliography_databases(spark, d):
    """Entries of bibliography databases."""
    text = F.concat(
        F.lit("@article{k"), F.col("ref_id").cast("string"), F.lit(",\n author = {"), F.array_join("authors", " and "), F.lit("}"), F.coalesce(F.concat(F.lit(",\n title = {{"), F.col("title"), F.lit("}}")), F.lit("")),
        F.coalesce(F.concat(F.lit(",\n year = "), F.col("year").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(",\n doi = {"), "doi", F.lit("}")), F.lit("")), F.lit("\n}\n"),
    )
    x = _hexed(_truth(spark, d)).select(F.explode(latex.parse_bib(text)).alias("e"))
    return x.select("e.key", "e.title", "e.authors", "e.year", "e.doi")


@q(rf"""SELECT 'k' || ref_id AS key, coalesce(hex(title), 'none') AS title, true AS cited FROM source_refs""")
def typeset_lists(spark, d):
    """Entries of typeset lists, and the keys that the text before them cites."""
    key = F.concat(F.lit("k"), F.col("ref_id").cast("string"))
    text = F.concat(F.lit("\\begin{thebibliography}{9}\n% \\bibitem{no} none\n\\bibitem{"), key, F.lit("} "), F.array_join("authors", ", "), F.lit(".\n\\newblock "), F.coalesce("title", F.lit("none")), F.lit(".\n\\newblock 2001.\n\\end{thebibliography}"))
    main = F.concat(F.lit("\\cite[p.~1]{"), key, F.lit(", other} % \\cite{no}"))
    x = _hexed(_truth(spark, d)).select(F.explode(latex.parse_bbl(text)).alias("e"), latex.cited_keys(main).alias("c"))
    return x.select("e.key", "e.title", F.array_contains("c", F.col("e.key")).alias("cited"))


@q(r"""SELECT ext_id, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), ''), '/') AS url, lower(regexp_extract(url, '^(https?://[^/]+)', 1)) || '/next' AS resolved FROM extracted_refs WHERE url IS NOT NULL""")
def canonical_addresses(spark, d):
    """Canonical form of addresses, and a reference resolved against them."""
    u = table(spark, d, "extracted_refs").filter("url IS NOT NULL")
    return u.select("ext_id", W.normalize_url(F.col("url")).alias("url"), W.resolve_url(F.col("url"), F.lit("/a/../next")).alias("resolved"))


@q(r"""SELECT doc_id, title AS decoded, length(title) AS n FROM documents WHERE title IS NOT NULL""")
def percent_escapes(spark, d):
    """Titles as percent escapes and entities, and back."""
    t = table(spark, d, "documents").filter("title IS NOT NULL")
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return t.select("doc_id", W.percent_decode(W.percent_encode("title")).alias("decoded"), F.length(W.decode_entities(escaped)).cast("bigint").alias("n"))


@q(r"""SELECT run_key AS doc, idx AS offset, (SELECT list_sort(list_distinct(list(x.idx))) FROM extracted_refs x WHERE x.run_key = e.run_key AND lower(regexp_replace(x.surname, '^.*\s', '')) = lower(regexp_replace(e.surname, '^.*\s', '')) AND x.year = e.year) AS targets
       FROM extracted_refs e WHERE year BETWEEN 1000 AND 9999 AND surname IS NOT NULL AND regexp_matches(surname, '^[^\s]+$')""")
def citation_targets(spark, d):
    """Author-year citations of every reference's own author and year, resolved within their document."""
    e = table(spark, d, "extracted_refs").withColumnRenamed("run_key", "doc")
    markers = e.filter(F.col("year").between(1000, 9999) & F.col("surname").rlike(r"^\S+$")).select("doc", F.lit(1).alias("page"), F.col("idx").alias("offset"), F.lit("").alias("text"), F.concat("surname", F.lit(" et al.")).alias("name"), F.array(F.col("year").cast("string")).alias("years"))
    return citations.resolve_author_year(markers, e.select("doc", "idx", "surname", "year"), "doc").select("doc", "offset", "targets")


_REC = f"""(SELECT ext_id AS rec_id, title, year, venue, doi, ext_id % 4 AS r,
             list_filter(['doi:' || {_DOI}, CASE WHEN {{norm}} <> '' THEN 'title:' || {{norm}} || '|' || CAST(year AS VARCHAR) END], lambda x: x IS NOT NULL) AS ks FROM extracted_refs)""".replace("{norm}", r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))")


@q(rf"""WITH RECURSIVE rec AS {_REC}, k AS (SELECT rec_id, unnest(ks) AS k FROM rec), e AS (SELECT DISTINCT k.rec_id AS a, m AS b FROM k JOIN (SELECT k, min(rec_id) AS m FROM k GROUP BY k) USING (k)),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w(a, b) AS (SELECT rec_id, rec_id FROM rec UNION SELECT w.a, u.b FROM w JOIN u ON u.a = w.b)
        SELECT c AS component, count(*) AS members FROM (SELECT a, min(b) AS c FROM w GROUP BY a) GROUP BY c""")
def merged_components(spark, d):
    """How many records make up each work, by transitive keys."""
    from quillmill.operators import records as R

    r = table(spark, d, "extracted_refs").select(F.col("ext_id").alias("rec_id"), "title", "year", "doi")
    edges = r.select("rec_id", F.explode(R.match_keys(F.col("doi"), F.lit(None).cast("string"), F.col("title"), F.col("year"))).alias("k"))
    x = r.select("rec_id").join(R.components(edges, "rec_id", "k"), "rec_id", "left")
    return x.groupBy(F.coalesce("component", "rec_id").alias("component")).agg(F.count("*").alias("members"))


@q(rf"""SELECT pmcid, version, CASE WHEN NOT generic THEN title END AS title, {_DOI} AS doi, doi IS NOT NULL AS has_source, coalesce(CASE WHEN year BETWEEN 1900 AND 2099 THEN year END, NULL) AS info_year
        FROM (SELECT *, (lower(trim(title)) IN ('untitled', 'title', 'document', 'paper', 'manuscript', 'article', 'main', 'template', 'no title', 'none', 'unknown', 'slide 1', 'powerpoint presentation') OR trim(title) = '' OR regexp_matches(lower(trim(title)), '\.(?:pdf|docx?|tex|dvi|ps|indd|qxd|pptx?)$') OR regexp_matches(lower(trim(title)), '^(?:microsoft word|untitled|doi:|arxiv:)') OR NOT regexp_matches(lower(trim(title)), '\p{{L}}{{3}}')) AS generic FROM {_MANIFEST} WHERE title IS NOT NULL)""")
def merged_metadata(spark, d):
    """Metadata by precedence from the fields of a file: title, DOI with its provenance, year of its date."""
    none = F.lit(None).cast("string")
    m = _manifest(spark, d).filter("title IS NOT NULL")
    rows = m.select(F.concat_ws("|", "pmcid", "version").alias("doc_hash"), F.col("title").alias("info_title"), none.alias("info_author"), F.concat(F.lit("D:"), F.col("year").cast("string"), F.lit("0101")).alias("info_date"), F.concat(F.lit("doi "), F.col("doi")).alias("info_subject"), none.alias("page_title"), none.alias("page_doi"), F.lit(None).cast("int").alias("page_year"), none.alias("arxiv_id"))
    x = M.merge_metadata(rows)
    x = x.select("doc_hash", "title", "doi", "provenance").join(rows.select("doc_hash", I.year_from_pdf_date("info_date").alias("info_year")), "doc_hash")
    return x.select(F.substring_index("doc_hash", "|", 1).alias("pmcid"), F.substring_index("doc_hash", "|", -1).cast("int").alias("version"), "title", "doi", F.map_contains_key("provenance", "doi").alias("has_source"), "info_year")


@q(r"""SELECT doc_hash, count(*) AS windows FROM (SELECT doc_hash, unnest(range(greatest(1, CAST(ceil((n - 40) / 160.0) AS BIGINT)))) FROM (SELECT doc_hash, len(regexp_extract_all(text, '[^\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS n FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks)) WHERE n > 0) GROUP BY doc_hash""")
def page_windows(spark, d):
    """How many windows the index makes of each document's pages where no sentence starts."""
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"])
    # Without stops there is no sentence start to snap to, so the windows are the plain ones.
    plain = c.select("doc_hash", "chunk_id", F.regexp_replace("text", r"[.!?]", ",").alias("text"))
    return S.chunk_pages(plain, "doc_hash", "chunk_id").groupBy("doc_hash").agg(F.count("*").alias("windows"))
