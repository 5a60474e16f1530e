"""Queries of text, line, page and chunk operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.functions import web
from quillmill.operators import citations, cleanup, ledger, metadata, regions
from quillmill.operators import search as S
from quillmill.operators.evaluate import word_error_rate
from quillmill.plans.registry import Registry
from quillmill.session import table

QUERIES = Registry()
q = QUERIES.query
# Normal form of a title in DuckDB: the class is Alphabetic and N on the Spark side; these texts have no other letters.
NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
TOK = r"list_filter(regexp_split_to_array({0}, '[ \t\n\v\f\r]+'), lambda w: w <> '')"
NUMTOK = r"list_filter({0}, lambda w: regexp_matches(regexp_replace(w, '^[(\[{{<>≤≥~≈=±,;:*†‡]+|[)\]}},;:*†‡]+$', '', 'g'), '^[-+−±]?(?:[0-9]+(?:[.,][0-9]+)*|\.[0-9]+)(?:[eE×x][-+−]?[0-9]+)?(?:[±/–-][0-9.,]+)*[%‰°kKMB]?$'))"


def _chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"]).select("chunk_id", "doc_hash", "page", "idx", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


LINES = """(SELECT chunk_id, doc_hash, page, idx, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
            FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks WHERE text IS NOT NULL))"""


@q(f"""SELECT doc_id, {NORM.format('title')} AS norm, len(list_filter(string_split({NORM.format('title')}, ' '), lambda w: w <> '')) AS n_words FROM documents""")
def title_normal_form(spark, d):
    """Normal form and words of document titles."""
    return table(spark, d, "documents").select("doc_id", X.normalize_title("title").alias("norm"), F.size(X.words("title")).cast("bigint").alias("n_words"))


@q(r"""SELECT doc_id, array_to_string(TOK[1:8], ' ') AS lead, len(TOK) AS n, CASE WHEN length(text) > 120 THEN text[1:120] || ' […]' ELSE text END AS cut
       FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda w: w <> '') AS TOK FROM documents)""")
def text_heads(spark, d):
    """First words, token count and cut text of documents."""
    return table(spark, d, "documents").select("doc_id", X.leading_words("text", 8).alias("lead"), F.size(X.tokens("text")).cast("bigint").alias("n"), X.truncate_chars("text", 120).alias("cut"))


@q(rf"""SELECT doc_hash, key, count(DISTINCT page) AS pages, count(*) AS n
        FROM (SELECT doc_hash, page, regexp_replace(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')), '[0-9]+', '#', 'g') AS key FROM {LINES})
        WHERE regexp_matches(key, '\p{{L}}') GROUP BY ALL HAVING count(DISTINCT page) >= 2""")
def repeated_furniture(spark, d):
    """Digit-masked lines on two or more pages of a document."""
    x = _chunk_lines(spark, d).select("doc_hash", "page", X.digit_key("text").alias("key")).filter(F.col("key").rlike(r"\p{L}"))
    return x.groupBy("doc_hash", "key").agg(F.count_distinct("page").alias("pages"), F.count("*").alias("n")).filter("pages >= 2")


@q(rf"""SELECT is_toc, has_caption, fragment, prose, prose_like, ends, axis, mostly, count(*) AS n FROM (
          SELECT regexp_matches(text, '[0-9]$') AND (len(regexp_extract_all(text, ' \.')) + len(regexp_extract_all(text, '\.\.')) + len(regexp_extract_all(text, '…'))) >= 4 AS is_toc,
                 regexp_matches(trim(text), '^(?:Fig(?:ure|\.)?|FIG(?:URE|\.)?|Abb(?:ildung|\.)?|Tab(?:le|\.)?|TAB(?:LE|\.)?|Tabelle|Algorithm|ALGORITHM)\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXL]+|[A-Z]\.?[0-9]+)\s*[.:|–—-]') AS has_caption,
                 (t <= 4) OR (k >= 1 AND t - k <= 1) OR (t > 0 AND k * 10 >= t * 6) AS fragment,
                 t >= 6 AND lw * 2 >= t AND k * 10 < t * 3 AS prose,
                 t >= 7 AND k * 10 <= t * 3 AND caps <= 2 AND lw >= 2 AS prose_like,
                 regexp_matches(text, '[.?!]["''”’)\]]*\s*$') AS ends,
                 k >= 1 AND t - k <= 1 AS axis, t > 0 AND k * 10 >= t * 6 AS mostly
          FROM (SELECT text, len(w) AS t, len({NUMTOK.format('w')}) AS k, len(list_filter(w, lambda v: regexp_matches(v, '^\p{{Ll}}'))) AS lw, len(list_filter(w, lambda v: regexp_matches(v, '^\p{{Lu}}{{2,}}[^\p{{L}}]*$'))) AS caps
                FROM (SELECT text, {TOK.format('text')} AS w FROM {LINES}))) GROUP BY ALL""")
def line_predicates(spark, d):
    """How many lines of all chunks have which predicates."""
    t = "text"
    x = _chunk_lines(spark, d).select(X.is_toc(t).alias("is_toc"), X.caption_kind(t).isNotNull().alias("has_caption"), X.is_fragment(t).alias("fragment"), X.is_prose(t).alias("prose"), X.is_prose_like(t).alias("prose_like"), X.ends_sentence(t).alias("ends"), X.is_axis_like(t).alias("axis"), X.is_mostly_numeric(t).alias("mostly"))
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


_CAPTION = r"\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXL]+|[A-Z]\.?[0-9]+)\s*[.:|–—-]"
_MATH = r"(len(list_filter(w, lambda v: regexp_matches(v, '^\p{L}{3,}[.,;:]?$'))) <= 2 AND regexp_matches(text, '[=<>≤≥≈≡∈∑∏∫√±×·∂∇∞→↦⊂⊆∪∩∀∃^_{}]|\p{Sm}'))"
_ALGORITHM = r"(regexp_matches(t, '←|:=|▷|⊳') OR regexp_matches(t, '^(?i:(?:[0-9]+\s*[:.]?\s*)?(?:if\b.*\bthen|else\b|end\b|for\b.*\bdo|for each\b|foreach\b|while\b.*\bdo|repeat\b|until\b|return\b|require:?|ensure:?|input:|output:|procedure\b|function\b))'))"
_KIND = f"CASE WHEN regexp_matches(t, '^(?:Fig(?:ure|\\.)?|FIG(?:URE|\\.)?|Abb(?:ildung|\\.)?){_CAPTION}') THEN 'figure' WHEN regexp_matches(t, '^(?:Tab(?:le|\\.)?|TAB(?:LE|\\.)?|Tabelle){_CAPTION}') THEN 'table' WHEN regexp_matches(t, '^(?:Algorithm|ALGORITHM){_CAPTION}') THEN 'algorithm' END"


@q(rf"""SELECT CASE WHEN regexp_matches(t, '[0-9]$') AND len(regexp_extract_all(t, ' \.')) + len(regexp_extract_all(t, '\.\.')) + len(regexp_extract_all(t, '…')) >= 4 THEN 'toc' WHEN {_KIND} IS NOT NULL THEN 'caption'
               WHEN regexp_matches(t, '^(?i:(?:abstract|introduction|references|bibliography|acknowledge?ments?|conclusions?|appendix)[^A-Za-z0-9_]*)$') OR (regexp_matches(t, '^(?:[0-9]+(?:\.[0-9]+)*|[IVX]+\.)\s+\p{{Lu}}') AND len(w) <= 12 AND NOT regexp_matches(t, '[.,;]\r?$')) THEN 'heading'
               WHEN {_MATH.replace("text", "t")} THEN 'math' ELSE 'body' END AS role, count(*) AS n FROM (SELECT trim(text, ' ') AS t, {TOK.format("trim(text, ' ')")} AS w FROM {LINES}) GROUP BY 1""")
def line_roles(spark, d):
    """Lines by role."""
    return cleanup.role_counts(_chunk_lines(spark, d))


@q(rf"""SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '\p{{L}}+(?:-\p{{L}}+)+|\p{{L}}+')) AS word FROM documents) GROUP BY word""")
def vocabulary(spark, d):
    """Words and hyphenated pairs of the corpus with their counts."""
    words = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:-\p{L}+)+|\p{L}+"), F.lit(0))).alias("word"))
    per_doc = words.groupBy("word", "doc_id").agg(F.count("*").alias("k"))
    return per_doc.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@q(r"""SELECT ext_id, nullif(regexp_replace(regexp_extract(raw, '10\.[0-9]{4,9}/[^\s"<>]+'), '[.,;:''"”’\]}>*]+$', ''), '') AS doi_raw, len(regexp_extract_all(raw, '[0-9]+')) AS digit_runs,
              TRY_CAST(coalesce(nullif(regexp_extract(raw, '\(((?:1[5-9]|20)[0-9]{2})[a-z]?\)', 1), '')) AS INTEGER) AS bracket_year FROM extracted_refs""")
def reference_identifiers(spark, d):
    """First DOI, digit runs and bracketed year of raw references."""
    e = table(spark, d, "extracted_refs")
    return e.select("ext_id", F.nullif(F.regexp_replace(F.regexp_extract("raw", I.DOI, 0), r"[.,;:'\"”’\]}>*]+$", ""), F.lit("")).alias("doi_raw"), F.size(X.digit_runs("raw")).cast("bigint").alias("digit_runs"), I.first_match("raw", r"\(((?:1[5-9]|20)[0-9]{2})[a-z]?\)", 1).cast("int").alias("bracket_year"))


@q(r"""SELECT ext_id, CASE WHEN regexp_matches(b, '^10\.[0-9]{4,9}/\S') THEN lower(regexp_replace(regexp_extract(b, '^10\.[0-9]{4,9}/[^\s"<>]+'), '[.,;:''"”’\]}>*]+$', '')) END AS doi
       FROM (SELECT ext_id, regexp_replace(trim(doi), '^(?i)(?:https?://)?(?:dx\.)?(?:doi\.org/|doi\.[a-z]+/)?(?:doi\s*:?\s*)?', '') AS b FROM extracted_refs)""")
def doi_normal_form(spark, d):
    """Normal form of the references' DOIs."""
    return table(spark, d, "extracted_refs").select("ext_id", I.normalize_doi("doi").alias("doi"))


@q(r"""SELECT ext_id, TRY_CAST(nullif(regexp_extract(raw, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS INTEGER) AS first_year,
              len(list_filter(regexp_extract_all(raw, '[0-9]+'), lambda y: regexp_matches(y, '^(?:1[5-9][0-9]{2}|20[0-9]{2})$'))) AS n_years,
              regexp_replace(raw, '^\s*(?:\[[^\]]{1,12}\]|\([0-9]{1,4}\)|[0-9]{1,4}\.\s)\s*', '') AS body FROM extracted_refs""")
def reference_years(spark, d):
    """Years of raw references and the text without label."""
    e = table(spark, d, "extracted_refs")
    return e.select("ext_id", I.first_year("raw").alias("first_year"), F.size(I.all_years("raw")).cast("bigint").alias("n_years"), I.strip_label("raw").alias("body"))


@q(None)
def reference_fields(spark, d):
    """All fields of raw references, read again from their text."""
    e = table(spark, d, "extracted_refs").select("ext_id", "raw")
    return citations.parse_entries(e).drop("raw")


@q(None)
def reference_field_agreement(spark, d):
    """How often the fields read from raw text agree with the stored ones."""
    e = table(spark, d, "extracted_refs").select("ext_id", "raw", F.col("volume").alias("v"), F.col("year").alias("y"), F.col("title").alias("t"))
    p = citations.parse_entries(e)
    return p.agg(F.count("*").alias("n"), F.avg((F.col("volume") == F.col("v")).cast("double")).alias("volume"), F.avg((F.col("year") == F.col("y")).cast("double")).alias("year"), F.avg((X.normalize_title("title") == X.normalize_title("t")).cast("double")).alias("title"))


@q("""SELECT doc_hash, chunk_index, min(page) AS first_page, max(page) AS last_page, sha256(string_agg(text, chr(10) || chr(12) || chr(10) ORDER BY page)) AS text_sha256
      FROM (SELECT doc_hash, page, (page - 1) // 20 AS chunk_index, string_agg(coalesce(text, ''), chr(10) ORDER BY idx, chunk_id) AS text FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks) GROUP BY ALL) GROUP BY doc_hash, chunk_index""")
def page_chunks(spark, d):
    """Pages in groups of twenty with the digest of their texts."""
    c = table(spark, d, "search_chunks").dropDuplicates(["chunk_id"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "chunk_id", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    pages = c.groupBy("doc_hash", "page").agg(ordered.alias("text")).withColumn("warnings", F.array().cast("array<string>"))
    return ledger.chunk_results(pages).select("doc_hash", F.col("chunk_index").cast("bigint").alias("chunk_index"), "first_page", "last_page", "text_sha256")


@q(None)
def chunk_windows(spark, d):
    """Overlapping windows of documents, snapped to sentence starts."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(S.windows("text")).alias("idx", "text"))


@q(r"""SELECT chunk_id, n, line_no, start FROM (
         SELECT chunk_id, line_no, line, start, row_number() OVER (PARTITION BY chunk_id ORDER BY line_no) AS n FROM (
           SELECT chunk_id, line_no, text AS line, coalesce(sum(length(text) + 1) OVER (PARTITION BY chunk_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM """ + LINES + r""") WHERE trim(line, ' ') <> '')""")
def numbered_lines(spark, d):
    """Non-blank lines with number and character offset."""
    c = table(spark, d, "search_chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"])
    return ledger.numbered_lines(c, ["chunk_id"]).select("chunk_id", "n", F.col("line_no").cast("bigint").alias("line_no"), F.col("start").cast("bigint").alias("start"))


@q(rf"""SELECT a.doc_id, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 ELSE len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) END AS jaccard
        FROM (SELECT doc_id, list_distinct(list_filter(string_split(coalesce({NORM.format('title')}, ''), ' '), lambda w: w <> '')) AS wa FROM documents) a
        JOIN (SELECT doc_id - 1 AS doc_id, list_distinct(list_filter(string_split(coalesce({NORM.format('title')}, ''), ' '), lambda w: w <> '')) AS wb FROM documents) b ON a.doc_id = b.doc_id""")
def title_overlap(spark, d):
    """Jaccard similarity of the titles' words of neighbouring documents."""
    return _title_similarity(_neighbours(spark, d)).select("doc_id", "jaccard")


# SQL's edit distance counts bytes, this one characters, so brute force in the tests stands in for it.
@q(None)
def title_similarity(spark, d):
    """Jaccard and edit similarity of the titles of neighbouring documents."""
    return _title_similarity(_neighbours(spark, d))


def _neighbours(spark, d):
    nt = F.coalesce(X.normalize_title("title"), F.lit(""))
    x = table(spark, d, "documents").select("doc_id", nt.alias("nt"))
    return x.join(x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("nt").alias("mt")), "doc_id")


def _title_similarity(j):
    ws = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    return j.select("doc_id", X.jaccard(ws("nt"), ws("mt")).alias("jaccard"), X.similarity(F.col("nt"), F.col("mt")).alias("similarity"))


@q(None)
def title_word_errors(spark, d):
    """Word error rate between stored and read titles of a reference."""
    e = table(spark, d, "extracted_refs").select("ext_id", "title", "raw")
    return e.select("ext_id", word_error_rate(F.col("title"), F.col("raw")).alias("wer"))


@q("""SELECT doc_id, coalesce(count_if(length(x) >= 4), 0) AS long_words, coalesce(sum(length(x)), 0) AS letters FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS x FROM documents) GROUP BY doc_id""")
def ascii_words(spark, d):
    """Long words and letters of each document that has any."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).alias("x"))
    return x.groupBy("doc_id").agg(F.count_if(F.length("x") >= 4).alias("long_words"), F.sum(F.length("x")).alias("letters"))


@q(r"""SELECT doc_id, sha256(coalesce(text, '')) AS hash, length(text) AS n_chars, length(text) - length(replace(text, chr(10), '')) AS newlines FROM documents""")
def content_hash(spark, d):
    """SHA-256 identity and sizes of texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.length("text").cast("bigint").alias("n_chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("bigint").alias("newlines"))


@q(r"""SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) < 20 THEN 'short' WHEN bad * 100 >= greatest(length(text), 1) THEN 'unmapped' ELSE 'fine' END AS status
       FROM (SELECT doc_id, text, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(65533), '')) AS bad FROM documents)""")
def page_assessment(spark, d):
    """Texts that are nearly empty or badly decoded."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.when(ledger.looks_scanned(t, F.lit(1.0)), "short").when(ledger.has_unmapped_text(t, F.array().cast("array<string>")) , "unmapped").otherwise("fine").alias("status"))


@q(r"""SELECT pmcid, version, lower(regexp_extract(pdf_url, '^https?://([^/:]+)', 1)) AS host, regexp_matches(lower(pdf_url), '\.pdf$') AS is_pdf FROM (SELECT DISTINCT pmcid, version, pdf_url FROM manifest_items)""")
def pdf_addresses(spark, d):
    """Hosts and PDF verdicts of the manifest's addresses."""
    m = table(spark, d, "manifest_items").select("pmcid", "version", "pdf_url").distinct()
    return m.select("pmcid", "version", F.lower(F.parse_url("pdf_url", F.lit("HOST"))).alias("host"), (web.classify_pdf_url(F.col("pdf_url"))["verdict"] == "likely").alias("is_pdf"))


@q(None)
def url_normal_form(spark, d):
    """Canonical form of the references' addresses."""
    return table(spark, d, "extracted_refs").filter("url IS NOT NULL").select("ext_id", web.normalize_url(F.col("url")).alias("url"))


@q("""SELECT chunk_id, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '\\[[0-9]{1,4}(?:\\s*[,;–-]\\s*[0-9]{1,4})*\\]')))) AS groups FROM (SELECT DISTINCT ON (chunk_id) * FROM search_chunks WHERE text IS NOT NULL)""".replace("\\\\", "\\"))
def marker_groups(spark, d):
    """Bracketed number groups of each chunk."""
    c = table(spark, d, "search_chunks").filter("text IS NOT NULL").dropDuplicates(["chunk_id"])
    return c.select("chunk_id", F.size(F.regexp_extract_all("text", F.lit(r"\[[0-9]{1,4}(?:\s*[,;–-]\s*[0-9]{1,4})*\]"), F.lit(0))).cast("bigint").alias("groups"))


@q(None)
def author_year_citations(spark, d):
    """Author-year citations of each document with their offsets."""
    x = table(spark, d, "documents").select("doc_id", F.explode(citations.author_year_groups(F.col("text"))).alias("m"))
    return x.select("doc_id", "m.offset", "m.text", "m.name", F.array_join("m.years", ",").alias("years"))


@q(None)
def numeric_citations(spark, d):
    """Bracketed citations of each document with the numbers they stand for."""
    x = table(spark, d, "documents").select("doc_id", F.explode(citations.bracket_groups(F.col("text"))).alias("m"))
    return x.select("doc_id", "m.offset", "m.text", citations.cited_numbers(F.col("m.inner"), F.lit(999)).alias("targets"))


@q(rf"""SELECT fragment, prose, algorithm, math, table_row, caption, count(*) AS n FROM (
          SELECT (len(w) <= 4) OR (k >= 1 AND len(w) - k <= 1) OR (len(w) > 0 AND k * 10 >= len(w) * 6) AS fragment, len(w) >= 7 AND k * 10 <= len(w) * 3 AND caps <= 2 AND lw >= 2 AS prose, {_ALGORITHM} AS algorithm, {_MATH} AS math, len(w) <= 5 OR k >= 2 AS table_row, {_KIND} AS caption
          FROM (SELECT *, len({NUMTOK.format('w')}) AS k, len(list_filter(w, lambda v: regexp_matches(v, '^\p{{Ll}}'))) AS lw, len(list_filter(w, lambda v: regexp_matches(v, '^\p{{Lu}}{{2,}}[^\p{{L}}]*$'))) AS caps FROM (SELECT text, trim(text, ' ') AS t, {TOK.format('text')} AS w FROM {LINES}))) GROUP BY ALL""")
def region_flags(spark, d):
    """Counts of lines by the flags that region rules use."""
    x = regions.line_flags(_chunk_lines(spark, d).select("text"))
    return x.groupBy("fragment", "prose", "algorithm", "math", "table_row", "caption").agg(F.count("*").alias("n"))


@q(None)
def hyphen_mended(spark, d):
    """Lines of all chunks with words mended over line ends."""
    x = _chunk_lines(spark, d).withColumn("page", (F.col("page") * 1000 + F.col("idx")).cast("int")).withColumnRenamed("line_no", "line_idx")
    return cleanup.join_hyphens(x.select("doc_hash", "page", "line_idx", "text"))


@q("""SELECT doc_id, (lower(trim(title)) IN ('untitled', 'title', 'document', 'paper', 'manuscript', 'article', 'main', 'template', 'no title', 'none', 'unknown', 'slide 1', 'powerpoint presentation') OR trim(title) = ''
              OR regexp_matches(lower(trim(title)), '\\.(?:pdf|docx?|tex|dvi|ps|indd|qxd|pptx?)$') OR regexp_matches(lower(trim(title)), '^(?:microsoft word|untitled|doi:|arxiv:)') OR NOT regexp_matches(lower(trim(title)), '\\p{L}{3}')) AS generic FROM documents""".replace("\\\\", "\\"))
def generic_titles(spark, d):
    """Titles that are placeholders."""
    return table(spark, d, "documents").select("doc_id", metadata.title_is_generic("title").alias("generic"))


@q("""SELECT doc_id, lag(title) OVER w IS NOT NULL AS has_before, length(coalesce(lead(title) OVER w, '')) AS next_len, sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent
      FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def neighbouring_documents(spark, d):
    """Lag, lead and a moving frame over a source's documents."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", F.lag("title").over(w).isNotNull().alias("has_before"), F.length(F.coalesce(F.lead("title").over(w), F.lit(""))).cast("bigint").alias("next_len"), F.sum(F.coalesce("n_chars", F.lit(0))).over(w.rowsBetween(-2, 0)).alias("recent"))
