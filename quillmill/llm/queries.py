"""Queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm import boilerplate, canonical, confusables, encoding, linking, matching, packing, repetition, splitting
from quillmill.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every two rows that name the same person or group."""
    # Both branches of the pairing read the entities, so they are kept.
    return linking.same_entity_pairs(cut(linking.entities(table(spark, d, "creators"), table(spark, d, "source_refs"))))


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with its number of rows."""
    return linking.entities(table(spark, d, "creators"), table(spark, d, "source_refs")).groupBy("entity").agg(F.count("*").alias("rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that hold stand-in characters."""
    return confusables.stand_ins(confusables.title_values(table(spark, d, "source_refs"), table(spark, d, "extracted_refs")))


def p2_misread(spark: SparkSession, d: str) -> DataFrame:
    """Values with a word that a reading error made of ordinary characters."""
    return confusables.misread(confusables.title_values(table(spark, d, "source_refs"), table(spark, d, "extracted_refs")))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Consistent form and skeleton of every value."""
    return confusables.consistent_forms(confusables.title_values(table(spark, d, "source_refs"), table(spark, d, "extracted_refs")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a source entry and an extracted entry of the same work."""
    return matching.matches(table(spark, d, "source_refs"), table(spark, d, "extracted_refs")).select("ref_id", "ext_id")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same with a confidence."""
    return matching.matches(table(spark, d, "source_refs"), table(spark, d, "extracted_refs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that come out in more than one piece."""
    cuts = splitting.split_oversized(table(spark, d, "search_chunks"), ["chunk_id"], with_text=False)
    return cuts.filter("piece = 1").select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chunks; ``piece`` counts within page and idx."""
    pieces = splitting.split_oversized(table(spark, d, "search_chunks"), ["doc_hash", "page", "idx", "chunk_id"])
    return pieces.dropDuplicates(["chunk_id", "piece"])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.keyed_lines(table(spark, d, "search_chunks"), table(spark, d, "manifest_items").select("pdf_sha256", "publisher"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of lines in at least 6 documents of the chunk's publisher."""
    return boilerplate.recurring(_lines(spark, d))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Recurring lines of each publisher with their excess over other publishers."""
    return boilerplate.line_statistics(_lines(spark, d))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts without the recurring lines."""
    return boilerplate.without_lines(table(spark, d, "search_chunks"), p5_found(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """First id of each group of copies with each other id."""
    runs = canonical.canonical_runs(table(spark, d, "extracted_refs"), "ext_id", canonical.reference_keys())
    return runs.filter("id <> first_id").select("first_id", F.col("id").alias("ext_id"))


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    """One row a record with its number of copies."""
    return canonical.collapse(canonical.canonical_runs(table(spark, d, "extracted_refs"), "ext_id", canonical.reference_keys()))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_corpus(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of every document, or piece of a document over the capacity."""
    return packing.pack(encoding.count_tokens(table(spark, d, "documents")), "doc_id", "n_tokens", 2048)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 0.3 is repeated."""
    return repetition.repetition(table(spark, d, "documents")).filter("share >= 0.3").select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of repeated content of every document."""
    return repetition.repetition(table(spark, d, "documents"))


def p9_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every document's histograms from its language's."""
    return repetition.divergence(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    """All queries of this subpackage by name."""
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express over whole tables."""
    white = r"[^\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    line = r"lower(upper(regexp_replace(x, '[^\p{L}]+', '', 'g')))"
    canon = r"""
        SELECT ext_id,
               coalesce((SELECT string_agg(w, ' ' ORDER BY w) FROM unnest(regexp_extract_all(lower(upper(raw)), '[\p{L}\p{M}]+')) u(w) WHERE length(w) > 3), '')
               || '|' || coalesce((SELECT string_agg(c, '' ORDER BY c) FROM unnest(string_split(array_to_string(list_filter(regexp_extract_all(lower(upper(raw)), '[\p{L}\p{M}]+'), lambda w: length(w) <= 3), ''), '')) u(c)), '')
               || '|' || coalesce((SELECT string_agg(n, ' ' ORDER BY n) FROM unnest(regexp_extract_all(raw, '\p{Nd}+')) u(n)), '') AS k0,
               regexp_replace(lower(upper(title)), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS k1,
               regexp_replace(CASE WHEN regexp_extract(lower(doi), '10\s*\.\s*\d.*') <> '' THEN regexp_extract(lower(doi), '10\s*\.\s*\d.*') ELSE lower(doi) END, '[^\p{L}\p{N}]+', '', 'g') AS k2,
               raw IS NULL AS n0
        FROM extracted_refs"""
    runs = f"SELECT min(ext_id) OVER (PARTITION BY CASE WHEN n0 THEN NULL ELSE k0 END, k1, k2) AS first_id, ext_id FROM ({canon})"
    return {
        "p4_found": f"SELECT DISTINCT chunk_id FROM search_chunks WHERE len(regexp_extract_all(text, '{white}')) > 200",
        "p5_found": f"""
            WITH s AS (SELECT DISTINCT pdf_sha256 AS doc, publisher FROM manifest_items WHERE publisher IS NOT NULL),
                 l AS (SELECT chunk_id, doc_hash AS doc, publisher, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
                       FROM search_chunks JOIN s ON doc_hash = s.doc),
                 k AS (SELECT *, {line} AS k FROM l),
                 o AS (SELECT publisher, k FROM k WHERE k <> '' GROUP BY ALL HAVING count(DISTINCT doc) >= 6)
            SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM k JOIN o USING (publisher, k)""",
        "p6_found": f"SELECT first_id, ext_id FROM ({runs}) WHERE first_id <> ext_id",
        "p6_records": f"SELECT first_id, count(*) AS copies FROM ({runs}) GROUP BY first_id",
    }
