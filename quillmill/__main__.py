"""Command line: ``python -m quillmill extract|index|query|stats``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillmill.operators import ledger
from quillmill.operators import search as S
from quillmill.plans import pipeline
from quillmill.sources import files


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """PDF files to the tables of a ledger; running it again on the same files changes nothing."""
    docs = files.snapshot(spark, a.path, max_bytes=a.max_bytes, recursive=a.recursive)
    for name, table in pipeline.extract(docs).items():
        keys = [c for c in ("doc_hash", "page", "line_idx", "idx", "offset") if c in table.columns]
        keyed = table.withColumn("row_key", F.concat_ws("|", *keys)).withColumn("hash_prefix", F.substring("doc_hash", 1, 2))
        ledger.publish(keyed, f"{a.out}/{name}", key="row_key")


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks of a ledger to an index of chunks, with the digest of each document; unchanged documents are left alone."""
    chunks = spark.read.parquet(f"{a.ledger}/chunks").drop("row_key", "hash_prefix")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    current = chunks.groupBy("doc_hash").agg(texts.alias("t")).select("doc_hash", S.run_fingerprint(F.col("doc_hash"), F.lit(""), F.col("t")).alias("fingerprint"))
    try:
        stale = S.stale_documents(spark.read.parquet(f"{a.index}/chunks").select("doc_hash", "fingerprint").distinct(), current)
    except Exception:
        stale = current
    fresh = chunks.join(stale, "doc_hash").withColumn("chunk_id", F.xxhash64("doc_hash", "page", "idx")).withColumn("hash_prefix", F.substring("doc_hash", 1, 2))
    ledger.publish(fresh, f"{a.index}/chunks", key="doc_hash")


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hits of one query, best first."""
    chunks = spark.read.parquet(f"{a.index}/chunks")
    asked = spark.createDataFrame([(0, a.text)], "query_id int, query string")
    hits = S.bm25_top_k(chunks, asked, a.k) if a.mode == "lexical" else S.hybrid_search(chunks, asked, a.k, 1.0 if a.mode == "semantic" else a.alpha)
    for r in S.with_snippet(hits, chunks.select("chunk_id", "doc_hash", "page", "text")).join(chunks.select("chunk_id", "doc_hash", "page"), "chunk_id").orderBy("rank").collect():
        print(f"{r['rank']}\t{r.score:.4f}\t{r.doc_hash[:12]}\tp{r.page}\t{r.snippet}")


def stats(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sizes of an index."""
    c = spark.read.parquet(f"{a.index}/chunks")
    r = c.agg(F.count_distinct("doc_hash").alias("documents"), F.count("*").alias("chunks")).first()
    print(f"documents\t{r.documents}\nchunks\t{r.chunks}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillmill")
    sub = p.add_subparsers(required=True)
    e = sub.add_parser("extract", help=extract.__doc__)
    e.add_argument("path")
    e.add_argument("out")
    e.add_argument("--max-bytes", type=int)
    e.add_argument("--recursive", action="store_true")
    e.set_defaults(run=extract)
    i = sub.add_parser("index", help=index.__doc__)
    i.add_argument("ledger")
    i.add_argument("index")
    i.set_defaults(run=index)
    q = sub.add_parser("query", help=query.__doc__)
    q.add_argument("index")
    q.add_argument("text")
    q.add_argument("-k", type=int, default=10)
    q.add_argument("--mode", choices=("lexical", "semantic", "hybrid"), default="hybrid")
    q.add_argument("--alpha", type=float, default=0.5)
    q.set_defaults(run=query)
    s = sub.add_parser("stats", help=stats.__doc__)
    s.add_argument("index")
    s.set_defaults(run=stats)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("quillmill").getOrCreate(), a)


if __name__ == "__main__":
    main()
