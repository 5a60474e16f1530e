"""Queries of runs, records, resolution and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions import text as X
from quillmill.operators import evaluate as E
from quillmill.operators import ledger as L
from quillmill.operators import records as R
from quillmill.operators import resolve as V
from quillmill.operators import search as S
from quillmill.plans.registry import Registry
from quillmill.session import table

QUERIES = Registry()
q = QUERIES.query
NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
DOI = r"CASE WHEN regexp_matches({0}, '^10\.[0-9]{{4,9}}/\S') THEN lower(regexp_replace(regexp_extract({0}, '^10\.[0-9]{{4,9}}/[^\s\"<>]+'), '[.,;:''\"”’\]}}>*]+$', '')) END"
BARE = r"regexp_replace(trim({0}), '^(?i)(?:https?://)?(?:dx\.)?(?:doi\.org/|doi\.[a-z]+/)?(?:doi\s*:?\s*)?', '')"


def _runs(spark, d):
    return table(spark, d, "runs").dropDuplicates(["run_key"])


RUNS = "(SELECT DISTINCT ON (run_key) * FROM runs)"


@q(f"""SELECT hash, run_key, status, finished_at FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY finished_at DESC NULLS LAST, run_key DESC) AS n FROM {RUNS} WHERE status IN ('complete', 'partial')) WHERE n = 1""")
def run_latest(spark, d):
    """Latest usable run of each document."""
    return S.latest_runs(_runs(spark, d)).select("hash", "run_key", "status", "finished_at")


@q(f"""SELECT status, backend_name, count(*) AS runs, count(DISTINCT hash) AS documents, round(avg(timings.parse_ms), 6) AS parse_ms, quantile_disc(timings.parse_ms, 0.95) AS p95, median(timings.parse_ms) AS med FROM {RUNS} GROUP BY ALL""")
def run_statistics(spark, d):
    """Runs by status and backend with timings; the percentile is by nearest rank."""
    return _runs(spark, d).groupBy("status", "backend_name").agg(F.count("*").alias("runs"), F.count_distinct("hash").alias("documents"), F.round(F.avg("timings.parse_ms"), 6).alias("parse_ms"), E.percentile_nearest("timings.parse_ms", 0.95).alias("p95"), F.median("timings.parse_ms").alias("med"))


@q(f"""SELECT backend_name, (list_sort(list(timings.parse_ms)))[CAST(round((count(*) - 1) * 0.9) AS BIGINT) + 1] AS p90 FROM {RUNS} WHERE timings.parse_ms IS NOT NULL GROUP BY backend_name""")
def run_percentiles(spark, d):
    """The other percentile rule: the element at the rounded share of the last index."""
    return E.percentile_by_rank(_runs(spark, d), "backend_name", "timings.parse_ms", 0.9).select("backend_name", F.col("parse_ms").alias("p90"))


@q(f"""SELECT run_key, sha256(concat_ws(chr(31), hash, backend_name, backend_version, config_digest, CAST(schema_version AS VARCHAR))) AS natural_key, list_has_any(coalesce(list_transform(warnings, lambda w: split_part(w, ':', 1)), []), ['failed', 'resource_limit', 'unicode_mapping', 'extraction_incomplete']) AS partial FROM {RUNS}""")
def run_identity(spark, d):
    """Natural key and page status rule of each run."""
    r = _runs(spark, d)
    key = L.run_key(hash_=F.col("hash"), name=F.col("backend_name"), version=F.col("backend_version"), digest=F.col("config_digest"), schema=F.col("schema_version"))
    return r.select("run_key", key.alias("natural_key"), (L.page_status(F.col("warnings")) == "partial").alias("partial"))


@q(f"""SELECT (SELECT count(*) FROM {RUNS}) AS runs, (SELECT count(DISTINCT hash) FROM {RUNS}) AS documents, (SELECT count(*) FROM extracted_refs) AS refs, (SELECT count(*) FROM (SELECT DISTINCT chunk_id FROM search_chunks)) AS chunks,
              (SELECT count_if(status = 'partial') FROM {RUNS}) AS partial, (SELECT count_if(doi IS NOT NULL) FROM extracted_refs) AS refs_with_doi""")
def ledger_stats(spark, d):
    """Counts over the ledger, one aggregate a table."""
    r = _runs(spark, d).agg(F.count("*").alias("runs"), F.count_distinct("hash").alias("documents"), F.count_if(F.col("status") == "partial").alias("partial"))
    e = table(spark, d, "extracted_refs").agg(F.count("*").alias("refs"), F.count("doi").alias("refs_with_doi"))
    c = table(spark, d, "search_chunks").agg(F.count_distinct("chunk_id").alias("chunks"))
    return r.crossJoin(e).crossJoin(c)


@q(f"""SELECT m.pdf_sha256 AS hash, m.title, r.run_key, r.status FROM (SELECT pdf_sha256, min(title) AS title FROM manifest_items GROUP BY 1) m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY finished_at DESC NULLS LAST, run_key DESC) AS n FROM {RUNS} WHERE status IN ('complete', 'partial')) WHERE n = 1) r ON r.hash = m.pdf_sha256""")
def ledger_corpus(spark, d):
    """Every document of the manifest with its latest run, if any."""
    m = table(spark, d, "manifest_items").groupBy(F.col("pdf_sha256").alias("hash")).agg(F.min("title").alias("title"))
    return L.corpus(S.latest_runs(_runs(spark, d)).select("hash", "run_key", "status"), m).select("hash", "title", "run_key", "status")


@q(f"""SELECT e.run_key, r.hash, count(*) AS refs, count(DISTINCT e.venue) AS venues, count_if(coalesce(e.year, 0) >= 2000) AS recent, min(e.year) AS first_year FROM extracted_refs e JOIN {RUNS} r USING (run_key) GROUP BY ALL""")
def references_by_run(spark, d):
    """References of each run with its document."""
    e, r = table(spark, d, "extracted_refs"), _runs(spark, d).select("run_key", "hash")
    counted = e.groupBy("run_key").agg(F.count("*").alias("refs"), F.count_distinct("venue").alias("venues"), F.count_if(F.col("year") >= 2000).alias("recent"), F.min("year").alias("first_year"))
    return counted.join(r, "run_key").select("run_key", "hash", "refs", "venues", "recent", "first_year")


def _ref_records(spark, d):
    e = table(spark, d, "extracted_refs")
    source = F.element_at(F.array(*map(F.lit, R.SOURCES)), (F.col("ext_id") % 4 + 1).cast("int"))
    return e.select(F.col("ext_id").alias("rec_id"), "title", "authors", "year", "venue", "doi", "arxiv_id", source.alias("source"))


@q(f"""SELECT k AS match_key, count(*) AS records FROM (
         SELECT unnest(list_filter([ 'doi:' || {DOI.format('b')}, CASE WHEN {NORM.format('title')} <> '' THEN 'title:' || {NORM.format('title')} || '|' || CAST(year AS VARCHAR) END ], lambda x: x IS NOT NULL)) AS k
         FROM (SELECT title, year, {BARE.format('doi')} AS b FROM extracted_refs)) GROUP BY 1""")
def record_keys(spark, d):
    """Blocking keys of all references, and how many records share them."""
    return _record_keys(table(spark, d, "extracted_refs"))


def _record_keys(e):
    return e.select(F.explode(R.match_keys(F.col("doi"), F.lit(None).cast("string"), F.col("title"), F.col("year"))).alias("match_key")).groupBy("match_key").agg(F.count("*").alias("records"))


@q(None)
def merged_records(spark, d):
    """References of one work merged by transitive keys, fields by source rank."""
    return R.merge_records(_ref_records(spark, d))


@q(None)
def reference_matches(spark, d):
    """Greedy matching of each venue-year's source entries with its extracted ones, as truth and output of one document."""
    doc = F.concat_ws("|", F.lower(F.substring("title", 1, 2)), F.col("year").cast("string"))
    side = lambda t, i: t.filter("title IS NOT NULL").select(doc.alias("doc"), F.col(i).cast("int").alias("idx"), I.normalize_doi("doi").alias("doi"), I.normalize_arxiv("arxiv_id").alias("arxiv"), X.normalize_title("title").alias("title"), "year", F.lower("surname").alias("author"), F.lit(None).cast("string").alias("venue"), X.normalize_title("title").alias("text"))
    return E.match_references(side(table(spark, d, "source_refs"), "ref_id"), side(table(spark, d, "extracted_refs"), "ext_id"))


@q(rf"""WITH t AS (SELECT surname AS doc, ref_id, {NORM.format('title')} AS k FROM source_refs WHERE title IS NOT NULL AND surname IS NOT NULL),
        e AS (SELECT surname AS doc, ext_id, {NORM.format('title')} AS k FROM extracted_refs WHERE title IS NOT NULL AND surname IS NOT NULL)
        SELECT a.doc, ref_id AS t_idx, ext_id AS e_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY ref_id) AS n FROM t) a JOIN (SELECT *, row_number() OVER (PARTITION BY doc, k ORDER BY ext_id) AS n FROM e) b ON a.doc = b.doc AND a.k = b.k AND a.n = b.n""")
def exact_title_pass(spark, d):
    """One-to-one matches of equal titles under one surname."""
    return _exact_titles(table(spark, d, "source_refs").filter("title IS NOT NULL"), table(spark, d, "extracted_refs").filter("title IS NOT NULL"))


def _exact_titles(source_refs, extracted_refs):
    t = source_refs.filter("surname IS NOT NULL").select(F.col("surname").alias("doc"), F.col("ref_id").alias("t_idx"), X.normalize_title("title").alias("k"))
    e = extracted_refs.filter("surname IS NOT NULL").select(F.col("surname").alias("doc"), F.col("ext_id").alias("e_idx"), X.normalize_title("title").alias("k"))
    return E.exact_pass(t, e, "k").select("doc", "t_idx", "e_idx")


@q(None)
def verified_references(spark, d):
    """Extracted entries resolved against the source entries as registry: every pair that verifies, ambiguity by margin."""
    e = table(spark, d, "extracted_refs").select(F.col("ext_id").alias("entry_id"), V.folded(F.col("raw")).alias("entry"))
    r = table(spark, d, "source_refs").select(F.col("ref_id").alias("record_id"), V.folded(F.col("title")).alias("title"), V.folded(F.get("authors", F.lit(0))).alias("author"), "year", I.normalize_doi("doi").alias("doi"))
    scored = V.verifiable_pairs(e, r).withColumn("score", V.verify(F.col("entry"), F.col("title"), F.col("author"), F.col("year")))
    return V.select_records(scored).select("entry_id", "record_id", F.round("score", 6).alias("score"), "outcome")


@q("""SELECT paper_id, count(*) AS truth, count(doi) AS extracted, count_if(doi IS NOT NULL AND year IS NOT NULL) AS matched FROM source_refs GROUP BY paper_id""")
def paper_counts(spark, d):
    """Per-paper counts."""
    return table(spark, d, "source_refs").groupBy("paper_id").agg(F.count("*").alias("truth"), F.count("doi").alias("extracted"), F.count_if(F.col("doi").isNotNull() & F.col("year").isNotNull()).alias("matched"))


@q("""SELECT count(*) AS papers, CAST(sum(truth) AS BIGINT) AS truth, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(matched) AS BIGINT) AS matched, round(sum(matched) / sum(truth), 9) AS recall, round(sum(matched) / sum(extracted), 9) AS precision, round(avg(CASE WHEN truth = extracted THEN 1.0 ELSE 0.0 END), 9) AS count_exact
      FROM (SELECT paper_id, count(*) AS truth, count(doi) AS extracted, count_if(doi IS NOT NULL AND year IS NOT NULL) AS matched FROM source_refs GROUP BY paper_id)""")
def corpus_rates(spark, d):
    """Rates over all papers as sums of counts."""
    s = E.summarize(paper_counts(spark, d))
    return s.select("papers", "truth", "extracted", "matched", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "count_exact")))


@q("""SELECT item_key, string_agg(coalesce(name, trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))), '; ' ORDER BY seq, creator_id) AS authors FROM creators WHERE creator_type = 'author' GROUP BY item_key""")
def library_authors(spark, d):
    """Author lines of library items in their order."""
    c = table(spark, d, "creators").filter("creator_type = 'author'")
    name = F.coalesce("name", F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit("")))))
    return c.groupBy("item_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "creator_id", name.alias("n")))), lambda x: x["n"]), "; ").alias("authors"))


@q("""SELECT e.ext_id FROM extracted_refs e WHERE NOT EXISTS (SELECT 1 FROM source_refs s WHERE lower(s.surname) = lower(e.surname) AND s.year = e.year)""")
def references_without_source(spark, d):
    """Extracted entries that no source entry shares surname and year with."""
    e = table(spark, d, "extracted_refs").select("ext_id", F.lower("surname").alias("k"), "year")
    s = table(spark, d, "source_refs").select(F.lower("surname").alias("k"), "year").distinct()
    return e.join(s, ["k", "year"], "left_anti").select("ext_id")


@q("""SELECT j.publisher, count(*) AS refs, count(DISTINCT e.run_key) AS runs FROM extracted_refs e JOIN journals j ON e.venue = j.journal OR e.venue = j.abbrev GROUP BY j.publisher""")
def references_by_publisher(spark, d):
    """References by publisher through full or short journal names; the journals are a fixed list of about a hundred."""
    j = table(spark, d, "journals")
    names = j.select("publisher", F.explode(F.array_distinct(F.array("journal", "abbrev"))).alias("venue"))
    return table(spark, d, "extracted_refs").join(names, "venue").groupBy("publisher").agg(F.count("*").alias("refs"), F.count_distinct("run_key").alias("runs"))


@q("""SELECT publisher, pmcid, version FROM (SELECT DISTINCT publisher, pmcid, version FROM manifest_items) QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY sha256('7|' || pmcid), pmcid, version) <= 5""")
def stratified_items(spark, d):
    """Five manifest items of each publisher."""
    from quillmill.operators.sampling import stratified

    return stratified(table(spark, d, "manifest_items").select("publisher", "pmcid", "version").distinct(), ["publisher"], "pmcid", 5, "7")


@q("""SELECT license_code, count(*) AS items, count(r.hash) AS evaluated, count(*) - count(r.hash) AS missing FROM (SELECT DISTINCT pdf_sha256 AS hash, license_code FROM manifest_items) m LEFT JOIN (SELECT DISTINCT hash FROM runs WHERE status = 'complete') r USING (hash) GROUP BY license_code""")
def manifest_coverage(spark, d):
    """How many of the manifest's documents have a complete run, by licence."""
    from quillmill.operators.sampling import coverage

    m = table(spark, d, "manifest_items").select(F.col("pdf_sha256").alias("hash"), "license_code")
    done = table(spark, d, "runs").filter("status = 'complete'").select("hash").join(m.select("hash").distinct(), "hash", "left_semi")
    return coverage(m, done, "hash", "license_code")
