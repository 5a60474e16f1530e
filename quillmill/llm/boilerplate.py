"""Problem 5: lines that recur in many documents of one source.

Texts become lists of line keys (two hashes of the line's letters) in one narrow stage, joined to the documents'
sources and written once; neither texts nor lines are moved again. Each line's documents within its source are counted
with partial sums. The lines in at least ``least_docs`` documents of a source are tested: their share of the source's
documents is held against the share outside the source by a log-likelihood ratio, and, for lines that are as common
elsewhere, against what an ordinary line of the source has. The bounds hold the false-discovery rate (Benjamini and
Hochberg); they come from a histogram of the ratios, so no global sort is needed.

Occurrences of the significant lines are found by joining back: by broadcast where there are few such lines, which is
counted first, else by a shuffle in which each line is spread over several tasks.

Lines end at LF; a line without letters, a null text and a document without source are no case. Repeated chunk rows
count once and are found once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.joins import having
from quillmill.session import cut, written

#: Ratios are counted in steps of one over this, up to ``MOST`` steps; this bounds what reaches the driver.
STEPS, MOST = 4, 4000


def line_key(c):
    """A line's letters in one letter case."""
    return F.lower(F.upper(F.regexp_replace(c, r"[^\p{L}]+", "")))


def keyed_lines(chunks: DataFrame, sources: DataFrame, id_col: str = "chunk_id", doc_col: str = "doc_hash", text_col: str = "text") -> DataFrame:
    """``(chunk_id, line_no, source, doc, x, h)`` of every line with letters, written once; ``sources``: (doc, source), duplicates allowed."""
    keys = F.transform(F.split(F.col(text_col), "\n"), lambda x: line_key(x))
    listed = chunks.select(F.col(id_col).alias("chunk_id"), F.col(doc_col).alias("doc"), F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("x"), F.hash(k).alias("h")))).alias("keys")).filter(F.col("keys").isNotNull() & F.col("doc").isNotNull())
    known = sources.toDF("doc", "source").dropna().distinct()
    out = listed.join(known, "doc").select("chunk_id", "source", F.xxhash64("doc").alias("doc"), F.posexplode("keys").alias("line_no", "k")).filter("k IS NOT NULL")
    return written(out.select("chunk_id", "line_no", "source", "doc", F.col("k.x").alias("x"), F.col("k.h").alias("h")))


def line_counts(lines: DataFrame) -> DataFrame:
    """``(source, x, h, docs)``: in how many documents of its source each line stands."""
    return lines.select("source", "x", "h", "doc").distinct().groupBy("source", "x", "h").agg(F.count("*").alias("docs"))


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _bound(ratios: DataFrame, column: str, rate: float) -> float:
    """The least log-likelihood ratio that holds the false-discovery rate, rounded to the stricter side."""
    steps = ratios.groupBy(F.least(F.floor(F.col(column) * STEPS), F.lit(MOST)).alias("step")).agg(F.count("*").alias("n")).collect()
    tests, passed, bound = sum(r.n for r in steps), 0, math.inf
    for r in sorted(steps, key=lambda r: -r.step):
        passed += r.n
        if math.erfc(math.sqrt(r.step / STEPS / 2)) <= rate * passed / max(tests, 1):
            bound = r.step / STEPS
    return bound


def line_statistics(lines: DataFrame, least_docs: int = 6, rate: float = 0.01) -> DataFrame:
    """``(source, x, h, docs, all_docs, llr, beyond, excess, significant)`` of the lines in at least ``least_docs`` documents of a source.

    ``llr`` compares the shares within and outside the source, ``beyond`` the line with the source's mean line; both are
    0 where the share is not the greater one. ``excess``: significant by the first, ``significant``: by either.
    """
    inside = cut(line_counts(lines))
    sizes = lines.groupBy("source").agg(F.count_distinct("doc").alias("source_docs"))
    mean = inside.groupBy("source").agg(F.sum("docs").alias("sum_docs"), F.count("*").alias("n_lines"))
    n_all = sizes.agg(F.sum("source_docs")).first()[0] or 0
    often = inside.filter(F.col("docs") >= least_docs)
    # Partial sums first: a line has at most one row a source here.
    everywhere = inside.join(often.select("x", "h").distinct(), ["x", "h"], "left_semi").groupBy("x", "h").agg(F.sum("docs").alias("all_docs"))
    s = often.join(everywhere, ["x", "h"]).join(sizes.join(mean, "source"), "source")
    a, b = F.col("docs").cast("double"), (F.col("all_docs") - F.col("docs")).cast("double")
    n1, n2 = F.col("source_docs").cast("double"), F.lit(float(n_all)) - F.col("source_docs")
    p = (a + b) / F.lit(float(max(n_all, 1)))
    outside = F.when(n2 > 0, b / n2).otherwise(F.lit(0.0))
    ordinary = F.when(F.col("n_lines") > 1, (F.col("sum_docs") - F.col("docs")) / (F.col("n_lines") - 1)).otherwise(F.lit(1.0)) / n1
    llr = 2 * (_log_likelihood(a, n1, a / n1) + _log_likelihood(b, n2, outside) - _log_likelihood(a, n1, p) - _log_likelihood(b, n2, p))
    beyond = 2 * (_log_likelihood(a, n1, a / n1) - _log_likelihood(a, n1, ordinary))
    s = s.select(
        "source", "x", "h", "docs", "all_docs",
        F.when(a / n1 > outside, F.greatest(F.lit(0.0), llr)).otherwise(F.lit(0.0)).alias("llr"),
        F.when(a / n1 > ordinary, F.greatest(F.lit(0.0), beyond)).otherwise(F.lit(0.0)).alias("beyond"),
    )
    s = cut(s)
    excess = F.col("llr") >= F.lit(_bound(s, "llr", rate))
    return s.withColumn("excess", excess).withColumn("significant", excess | (F.col("beyond") >= F.lit(_bound(s, "beyond", rate))))


def recurring(lines: DataFrame, least_docs: int = 6, rate: float = 0.01) -> DataFrame:
    """The occurrences ``(chunk_id, line_no)`` of the significant lines in at least ``least_docs`` documents of their source."""
    found = line_statistics(lines, least_docs, rate).filter("significant").select("source", "x", "h")
    return having(lines, found, ["source", "x", "h"], "chunk_id").select("chunk_id", "line_no").distinct()


def without_lines(chunks: DataFrame, found: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, n_removed)``: each text without the found lines, put together again by position."""
    # At most one number a line of one chunk: bounded by the chunk.
    gone = found.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone")).withColumnRenamed("chunk_id", id_col)
    left = chunks.select(id_col, text_col).dropDuplicates([id_col]).join(gone, id_col, "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    return left.select(id_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
