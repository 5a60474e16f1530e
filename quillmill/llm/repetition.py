"""Problem 9: repetition inside one document.

``repetition`` measures the share of a text's units that lie in a run of five or more units which already began
earlier in the same text. Units are words (runs of letters, in one letter case); in a text of which most letters
are of a script written without spaces they are letters, in runs of ten. Runs are compared exactly: every run gets
a number by joining the numbers of two shorter ones, no fingerprints. Runs may overlap.

``divergence`` is the named method: character-class and common-word histograms of each document against those of
the document's language, by Jensen-Shannon distance, guarded by a minimal length. It tells that a text is unlike
its language, not which share of it is repeated, so the defined share comes from ``repetition`` (see the README).

Null texts and texts without units have share 0. Whole texts are measured, of any length.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = regex.compile(r"[\p{L}\p{M}]+")
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
ANY_LETTER = regex.compile(r"\p{L}")


def units_of(text: str) -> tuple[list[str], bool]:
    """The units compared, and whether they are single letters."""
    text = text.casefold()
    if not text.isascii() and (n := len(UNSPACED.findall(text))) and 2 * n > len(ANY_LETTER.findall(text)):
        return ANY_LETTER.findall(text), True
    return LETTERS.findall(text), False


def repeated_share(units: list[str], run: int) -> float:
    """Share of the units that lie in a run of at least ``run`` units that began earlier too."""
    n = len(units)
    if n <= run:
        return 0.0
    known: dict[str, int] = {}
    one = np.fromiter((known.setdefault(u, len(known)) for u in units), np.int64, n)
    if len(known) == n:
        return 0.0
    have, length = one, 1
    want, offset = run, 0
    # Numbers of runs of length 1, 2, 4, ...; those in the binary form of ``run`` are joined.
    joined: np.ndarray | None = None
    while want:
        if want & 1:
            piece = have[offset : offset + n - run + 1]
            joined = piece if joined is None else np.unique(joined * np.int64(n + 1) + piece, return_inverse=True)[1]
            offset += length
        want >>= 1
        if want:
            m = len(have) - length
            have = np.unique(have[:m] * np.int64(n + 1) + have[length:], return_inverse=True)[1]
            length *= 2
    _, first, which = np.unique(joined, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] < np.arange(len(joined)))
    if not len(again):
        return 0.0
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, again, 1)
    np.add.at(depth, again + run, -1)
    return float((np.cumsum(depth)[:n] > 0).mean())


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_run: int = 5, letter_run: int = 10) -> DataFrame:
    """``(id_col, n_units, by_letter, share)`` of every row; one narrow Arrow stage."""
    keyed = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, by, share = b.column(1), [], [], []
            for r in range(b.num_rows):
                units, letters = units_of(texts[r].as_py() or "")
                n.append(len(units))
                by.append(letters)
                share.append(repeated_share(units, letter_run if letters else word_run))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(by, pa.bool_()), pa.array(share, pa.float64())], [id_col, "n_units", "by_letter", "share"])

    return keyed.mapInArrow(run, T.StructType([keyed.schema[id_col], T.StructField("n_units", T.IntegerType()), T.StructField("by_letter", T.BooleanType()), T.StructField("share", T.DoubleType())]))


#: Languages with a histogram of their own; all else shares "other". This bounds what is sent to the workers.
LANGUAGES = ("de", "en", "es", "fr", "ja", "pt", "ru", "zh")
CLASSES = (r"\p{Lu}", r"\p{Ll}", r"\p{Lo}", r"\p{M}", r"\p{N}", r"[ \p{Zs}]", r"[\n\r\t]", r"[.,;:!?。，、]", r"[-–—]", r"[()\[\]{}]", r"\p{Sm}", r"[\p{P}\p{S}]")
COMMON_WORDS = 64


def _histograms(texts: list[str | None]) -> Iterator[tuple[list[int], Counter]]:
    patterns = [regex.compile(c) for c in CLASSES]
    for text in texts:
        text = text or ""
        yield [len(p.findall(text)) for p in patterns], Counter(units_of(text)[0])


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms; 1 if just one of them is empty, 0 if both are."""
    a, b = p.sum(), q.sum()
    if a == 0 or b == 0:
        return 0.0 if a == b else 1.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return math.sqrt(max(0.0, d / 2))


def divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_units: int = 20) -> DataFrame:
    """``(id_col, reference, js_classes, js_words)``: distances from the language's histograms, null under ``least_units`` units.

    The references are counted over all documents: characters by class, and the 64 most common units of each
    language. They hold at most 9 languages times 76 numbers, so the driver may gather and send them.
    """
    lang = F.lower(F.trim(F.col(lang_col)))
    keyed = docs.select(id_col, F.col(text_col).alias("__text"), F.when(lang.isin(*LANGUAGES), lang).otherwise("other").alias("__lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes: dict[str, np.ndarray] = {}
            words: dict[str, Counter] = {}
            for lng, (h, w) in zip(b.column(1).to_pylist(), _histograms(b.column(0).to_pylist()), strict=True):
                classes[lng] = classes.get(lng, 0) + np.array(h, np.int64)
                words.setdefault(lng, Counter()).update(w)
            rows = [(lng, f"\0{k}", int(v)) for lng, h in classes.items() for k, v in enumerate(h)] + [(lng, w, v) for lng, c in words.items() for w, v in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "unit", "n"])

    from pyspark.sql import Window

    counts = keyed.select("__text", "__lang").mapInArrow(count, "lang string, unit string, n bigint").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    # Partial top lists first, so that no task ranks a language's whole vocabulary.
    part = F.pmod(F.xxhash64("unit"), F.lit(64))
    top = counts.filter(~F.col("unit").startswith("\0")).withColumn("k", F.row_number().over(Window.partitionBy("lang", part).orderBy(F.desc("n"), "unit"))).filter(F.col("k") <= COMMON_WORDS)
    top = top.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "unit"))).filter(F.col("k") <= COMMON_WORDS).select("lang", "unit", "n")
    found = top.unionByName(counts.filter(F.col("unit").startswith("\0"))).collect()
    reference = {lng: (np.zeros(len(CLASSES)), {}) for lng in {r.lang for r in found}}
    for r in sorted(found, key=lambda r: (r.lang, -r.n, r.unit)):
        h, w = reference[r.lang]
        if r.unit.startswith("\0"):
            h[int(r.unit[1:])] = r.n
        else:
            w[r.unit] = r.n

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            js_c: list[float | None] = []
            js_w: list[float | None] = []
            for lng, (h, w) in zip(b.column(2).to_pylist(), _histograms(b.column(1).to_pylist()), strict=True):
                if sum(w.values()) < least_units:
                    js_c.append(None)
                    js_w.append(None)
                    continue
                ref_h, ref_w = reference[lng]
                js_c.append(jensen_shannon(np.array(h, float), ref_h))
                js_w.append(jensen_shannon(np.array([w[u] for u in ref_w], float), np.array(list(ref_w.values()), float)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(js_c, pa.float64()), pa.array(js_w, pa.float64())], [id_col, "reference", "js_classes", "js_words"])

    return keyed.mapInArrow(measure, T.StructType([keyed.schema[id_col], T.StructField("reference", T.StringType()), T.StructField("js_classes", T.DoubleType()), T.StructField("js_words", T.DoubleType())]))
