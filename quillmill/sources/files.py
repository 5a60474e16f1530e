"""Files as rows: documents with their content hash, manifests, archives of sources."""

from __future__ import annotations

import gzip
import io
import tarfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.session import batch_udf

#: Most bytes unpacked from one archive (fixed value).
UNPACKED = 200 * 1024 * 1024


def snapshot(spark: SparkSession, path: str, glob: str = "*.pdf", max_bytes: int | None = None, recursive: bool = False) -> DataFrame:
    """``(path, modified, size, content, hash)`` of files; the hash is the document's identity. Empty and oversized files are left out.

    The size limit is pushed to the file listing, so that such files are never opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.filter("length > 0")
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("hash"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Items of a corpus manifest, one row each."""
    m = spark.read.option("multiLine", "true").json(path)
    return m.select(F.explode("items").alias("i")).select("i.*")


@batch_udf("array<struct<path:string,content:binary>>")
def unpack_source(archives: pd.Series) -> pd.Series:
    """Files of a gzip, tar or single source; nothing for a PDF, a broken archive, a path outside it or too much data."""

    def one(b: bytes | None) -> list[dict]:
        if not b or b[:4] == b"%PDF":
            return []
        try:
            if b[:2] == b"\x1f\x8b":
                with gzip.GzipFile(fileobj=io.BytesIO(b)) as z:
                    b = z.read(UNPACKED + 1)
                if len(b) > UNPACKED:
                    return []
            if len(b) > 262 and b[257:262] == b"ustar":
                out, total = [], 0
                with tarfile.open(fileobj=io.BytesIO(b)) as t:
                    for m in t:
                        parts = m.name.split("/")
                        if not m.isfile() or m.name.startswith("/") or ".." in parts:
                            continue
                        total += m.size
                        if total > UNPACKED:
                            return []
                        out.append({"path": m.name, "content": t.extractfile(m).read()})
                return out
            return [{"path": "main.tex", "content": b}]
        except (OSError, EOFError, tarfile.TarError):
            return []

    return archives.map(one)


def figure_path(doc_hash: Column, backend: Column, digest: Column, page: Column, index: Column, mime: Column) -> Column:
    """Where an exported figure is stored."""
    ext = F.when(mime == "image/jpeg", "jpg").when(mime == "image/png", "png").when(mime == "image/jp2", "jp2").otherwise("bin")
    return F.concat(doc_hash, F.lit("/"), backend, F.lit("-"), F.left(digest, F.lit(8)), F.lit("/p"), page.cast("string"), F.lit("-f"), index.cast("string"), F.lit("."), ext)


def write_references_csv(refs: DataFrame, path: str) -> None:
    """References as CSV, attempts as ``method:outcome`` pairs, quotes doubled."""
    flat = refs.select(*[F.array_join(F.transform(c, lambda a: F.concat_ws(":", a["method"], a["outcome"])), "; ").alias(c) if c == "attempts" else F.array_join(c, "; ").alias(c) if dict(refs.dtypes)[c] == "array<string>" else F.col(c) for c in refs.columns])
    flat.write.mode("errorifexists").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def plain_text_list(refs: DataFrame, doc: str, idx: str = "idx", label: str = "label", raw: str = "raw") -> DataFrame:
    """``(doc, text)``: one line an entry, by its label or number."""
    line = F.concat(F.lit("["), F.coalesce(label, (F.col(idx) + 1).cast("string")), F.lit("] "), F.col(raw))
    return refs.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
