"""The run ledger as tables: identity, idempotent publication, views, routing of documents between extractors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import col

SCHEMA_VERSION = 5
CHUNK_PAGES = 20
RUN_KEY = ("hash", "backend_name", "backend_version", "config_digest", "schema_version")
#: Warnings that make a page partial (fixed values).
PARTIAL = r"^(?:failed|resource_limit|unicode_mapping|extraction_incomplete):"


def run_key(*, hash_: Column, name: Column, version: Column, digest: Column, schema: Column) -> Column:
    """Natural key of a run: digest of the parts that make it unique."""
    return F.sha2(F.concat_ws("\x1f", hash_, name, version, digest, schema.cast("string")), 256)


def config_digest(config: Column) -> Column:
    """Digest of a settings map, whatever the order of its entries."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(config)), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n"))), ""), 256)


def sub_range_digest(digest: Column, first: Column, last: Column) -> Column:
    """Identity of a run over a part of the pages."""
    return F.sha2(F.concat(digest, F.lit(":pages="), first.cast("string"), F.lit("-"), last.cast("string")), 256)


def page_range(first: Column, last: Column, count: Column) -> Column:
    """struct(first, last) within the document; an error for an empty or reversed range."""
    lo, hi = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), F.least(F.coalesce(last, count), count)
    return F.when(lo > hi, F.raise_error(F.lit("empty page range")).cast("struct<first:int,last:int>")).otherwise(F.struct(lo.cast("int").alias("first"), hi.cast("int").alias("last")))


def page_status(warnings: Column) -> Column:
    return F.when(F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: w.rlike(PARTIAL)), "partial").otherwise("complete")


def chunk_results(pages: DataFrame, doc: str = "doc_hash", size: int = CHUNK_PAGES) -> DataFrame:
    """``(doc, chunk_index, first_page, last_page, status, text_sha256)``: pages in groups of ``size``; at most so many texts a group."""
    part = F.floor((F.col("page") - 1) / size).cast("int")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    status = F.when(F.max((page_status(F.col("warnings")) == "partial").cast("int")) == 1, "partial").otherwise("complete")
    return pages.groupBy(doc, part.alias("chunk_index")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), status.alias("status"), F.sha2(F.array_join(texts, "\n\f\n"), 256).alias("text_sha256"))


def looks_scanned(text: Column, raster_share: Column) -> Column:
    """Hardly any text under a picture over half the page."""
    return (F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 20) & (F.coalesce(raster_share, F.lit(0.0)) >= 0.5)


def has_unmapped_text(text: Column, warnings: Column) -> Column:
    """A mapping warning, or one character in a hundred undecoded."""
    n = F.length(F.coalesce(text, F.lit("")))
    bad = n - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("�"), F.lit("")))
    return F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.startswith(w, F.lit("unicode_mapping:"))) | ((n > 0) & (bad * 100 >= n))


def assess(pages: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, pages, scanned, unmapped, empty, route)``; ``pages`` has text, warnings, raster_share."""
    a = pages.groupBy(doc).agg(
        F.count("*").alias("pages"), F.count_if(looks_scanned(F.col("text"), F.col("raster_share"))).alias("scanned"), F.count_if(has_unmapped_text(F.col("text"), F.col("warnings"))).alias("unmapped"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("empty"),
    )
    return a.withColumn("route", F.when(F.col("unmapped") > 0, "second").when(F.col("scanned") > 0, "ocr").otherwise("first"))


def prefer_candidate(native: DataFrame, candidate: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, use, reason)``: the candidate's pages replace the native ones unless something is lost.

    Both: (doc, page, status, text). A lost page or a page with less than half the decoded characters rejects it.
    """
    n = native.select(doc, "page", F.col("status").alias("ns"), F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("�"), F.lit(""))).alias("nl"))
    c = candidate.select(doc, "page", F.col("status").alias("cs"), F.length(F.replace(F.coalesce("text", F.lit("")), F.lit("�"), F.lit(""))).alias("cl"))
    x = n.join(c, [doc, "page"], "left")
    reason = F.when(F.col("cs").isNull(), "page lost").when((F.col("cs") == "failed") & (F.col("ns") != "failed"), "status").when(F.col("cl") * 2 < F.col("nl"), "text lost")
    return x.groupBy(doc).agg(F.min_by(F.when(reason.isNotNull(), reason), F.when(reason.isNotNull(), F.col("page"))).alias("reason")).select(doc, F.when(F.col("reason").isNull(), "candidate").otherwise("native").alias("use"), "reason")


def publish(new: DataFrame, path: str, key: str = "run_key", partition: str = "hash_prefix") -> None:
    """Write runs so that writing them again changes nothing: rows with a key that is there are replaced.

    The table is partitioned by ``partition``; only partitions that receive rows are rewritten.
    """
    spark = new.sparkSession
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(there):
        new.write.partitionBy(partition).parquet(path)
        return
    # The schema is given, since a table may hold no rows yet.
    old = spark.read.schema(new.schema).parquet(path)
    touched = new.select(partition).distinct()
    kept = old.join(touched, partition, "left_semi").join(new.select(key).distinct(), key, "left_anti")
    staging = f"{path}.staging"
    kept.unionByName(new).write.mode("overwrite").partitionBy(partition).parquet(staging)
    spark.read.schema(new.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging), True)


def with_prefix(df: DataFrame, hash_col: str = "hash", digits: int = 2) -> DataFrame:
    return df.withColumn("hash_prefix", F.substring(col(hash_col), 1, digits))


def open_ledger(spark: SparkSession, path: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """The run table; an error if it holds rows of a newer schema."""
    runs = spark.read.parquet(path)
    newest = runs.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > version:
        raise ValueError(f"the ledger has schema {newest}; this engine knows {version}")
    return runs


def latest_for_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """The latest run of hashes with a prefix: one row at most."""
    return runs.filter(F.col("hash").startswith(prefix)).orderBy(F.desc_nulls_last("finished_at"), F.desc("run_key")).limit(1)


def corpus(latest: DataFrame, documents: DataFrame, doc: str = "hash", title: str = "title") -> DataFrame:
    """Every document with its latest run, if any, in display order: titles first by their lower case, then the untitled."""
    return documents.join(latest, doc, "left").orderBy(F.col(title).isNull(), F.lower(F.col(title)), doc)


def numbered_lines(pages: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``(key, line_no, n, start, line)``: non-blank lines numbered from 1, with their character offset."""
    x = pages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    w = Window.partitionBy(*key).orderBy("line_no")
    x = x.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return x.filter(F.trim("line") != "").withColumn("n", F.row_number().over(w))


def document_context(pages: DataFrame, most: int, doc: str = "doc_hash") -> DataFrame:
    """``(doc, context)``: a document's pages in order, cut to ``most`` characters."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "idx", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.concat(F.lit("[page "), x["page"].cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return pages.groupBy(doc).agg(F.left(joined, F.lit(most)).alias("context"))


def load_result(run: DataFrame, pages: DataFrame, references: DataFrame, markers: DataFrame, key: str = "run_key") -> DataFrame:
    """A run with its pages, references and markers as sorted arrays; the rows of one run are a bounded group."""

    def nested(d: DataFrame, order: list[str], name: str) -> DataFrame:
        rest = [c for c in d.columns if c != key and c not in order]
        return d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(name))

    out = run
    for d, order, name in ((pages, ["page"], "pages"), (references, ["idx"], "references"), (markers, ["page", "offset"], "markers")):
        out = out.join(nested(d, order, name), key, "left")
    return out


def update_timings(runs: DataFrame, timings: DataFrame, key: str = "run_key") -> DataFrame:
    """Runs with the timings of those that have new ones."""
    new = timings.select(key, F.col("timings").alias("__new"))
    return runs.join(new, key, "left").withColumn("timings", F.coalesce("__new", "timings")).drop("__new")
