"""From PDF files to the tables of the ledger, in one plan for all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.operators import citations, cleanup, lines, metadata
from quillmill.operators import search as S
from quillmill.session import cut
from quillmill.sources import pdf


def extract(files: DataFrame, backend: str = "native") -> dict[str, DataFrame]:
    """Tables by name: pages, lines, furniture, roles, texts, chunks, references, markers, metadata.

    ``files``: (hash, content). Pages are read once and kept; every later step is a join or a group of one page or
    document.
    """
    pages = cut(pdf.read_pages(files, backend))
    page_lines = lines.page_lines(pdf.page_spans(pages)).join(pages.select("doc_hash", "page", F.col("height").cast("double").alias("page_height")), ["doc_hash", "page"])
    page_lines = cut(page_lines)
    furniture = cleanup.page_furniture(page_lines)
    body = cut(page_lines.join(furniture, ["doc_hash", "page", "line_idx"], "left_anti"))
    mended = cut(cleanup.join_hyphens(body))
    roles = mended.select("doc_hash", "page", "line_idx", cleanup.line_role("text").alias("role"))
    texts = cleanup.rebuild(mended, furniture.limit(0))
    references = cut(citations.parse_entries(citations.reference_entries(mended)))
    largest = references.groupBy("doc_hash").agg(F.count("*").cast("int").alias("n"))
    lists = citations.reference_sections(mended).groupBy("doc_hash").agg(F.min(F.struct("page", "line_idx")).alias("at"))
    before = mended.join(lists, "doc_hash", "left").filter(F.col("at").isNull() | (F.struct("page", "line_idx") < F.col("at")))
    markers = citations.numeric_markers(cleanup.rebuild(before.drop("at"), furniture.limit(0)), largest)
    title, doi, abstract = metadata.title_block(page_lines), metadata.page1_doi(page_lines), metadata.page1_abstract(body)
    info = pages.filter("page = 1").select("doc_hash", *(F.try_element_at("info", F.lit(k)).alias(a) for k, a in (("Title", "info_title"), ("Author", "info_author"), ("CreationDate", "info_date"), ("Subject", "info_subject"))))
    meta = info.join(title.withColumnRenamed("title", "page_title"), "doc_hash", "left").join(doi.select("doc_hash", F.col("doi").alias("page_doi")), "doc_hash", "left")
    year = metadata.page1_year(page_lines).withColumnRenamed("year", "page_year")
    arxiv = page_lines.filter("page = 1").groupBy("doc_hash").agg(F.min_by(I.find_arxiv("text"), F.when(I.find_arxiv("text").isNotNull(), F.col("line_idx"))).alias("arxiv_id"))
    meta = metadata.merge_metadata(meta.join(year, "doc_hash", "left").join(arxiv, "doc_hash", "left")).join(abstract, "doc_hash", "left")
    return {"pages": pages, "lines": page_lines, "furniture": furniture, "roles": roles, "texts": texts, "chunks": S.chunk_pages(texts), "references": references, "markers": markers, "metadata": meta}
