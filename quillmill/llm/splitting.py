"""Problem 4: cutting oversized texts at natural boundaries, with an overlap.

Every word boundary of a text is joined to its farthest legal successor: the last sentence or line end that keeps
the next piece, overlap included, within the limit, else the limit itself. Squaring the successor table again and
again marks all cuts that the greedy walk from the start would make, in a logarithmic number of vector steps.

A text is one row and is cut whole, however long. Null, empty and blank texts have no pieces. A text of at most
``limit`` words is one piece. Rows that come several times give the same pieces; the queries keep one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode White_Space (fixed value); str.split() counts four control characters more.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = regex.compile(f"[^{WHITE}]+")
LINE_END = regex.compile("[\n\r\x0b\x0c\x85\u2028\u2029]")
SENTENCE_END = regex.compile("[.!?…。！？｡][\"'”’»）)\\]]*$")


def successors(natural: np.ndarray, n: int, limit: int, overlap: int) -> np.ndarray:
    """For a cut at each boundary 0..n, the next cut. ``natural``: ascending natural boundaries."""
    at = np.arange(n + 1)
    start = np.maximum(at - overlap, 0)
    far = np.minimum(start + limit, n)
    stops = np.append(natural[natural < n], n)
    k = np.searchsorted(stops, far, "right") - 1
    best = np.where(k >= 0, stops[np.maximum(k, 0)], 0)
    return np.where(best > np.maximum(at, start + overlap), best, far)


def cuts(natural: np.ndarray, n: int, limit: int, overlap: int) -> np.ndarray:
    """All greedy cuts of n words, ascending, 0 and n included."""
    jump = successors(natural, n, limit, overlap)
    on = np.zeros(n + 1, bool)
    on[0] = True
    while True:
        on[jump[on]] = True
        if jump[0] == n:
            return np.flatnonzero(on)
        jump = jump[jump]


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first word, past the last word, first character, past the last character) of each piece."""
    # str.split() never counts fewer words, and is much faster than the pattern.
    spans = [m.span() for m in WORD.finditer(text)]
    n = len(spans)
    if not n:
        return []
    if n <= limit:
        return [(0, n, spans[0][0], spans[-1][1])]
    natural = [
        i for i in range(1, n)
        if LINE_END.search(text, spans[i - 1][1], spans[i][0]) or (text[spans[i - 1][1] - 1] in ".!?…。！？｡\"'”’»）)]" and SENTENCE_END.search(text[spans[i - 1][0] : spans[i - 1][1]]))
    ]
    c = cuts(np.array(natural, dtype=np.int64), n, limit, overlap)
    out = []
    for k in range(len(c) - 1):
        a = max(int(c[k]) - overlap, 0) if k else 0
        b = int(c[k + 1])
        out.append((a, b, spans[a][0], spans[b - 1][1]))
    return out


def split_oversized(chunks: DataFrame, id_cols: list[str], text_col: str = "text", limit: int = 200, overlap: int = 40, with_text: bool = True) -> DataFrame:
    """``id_cols, piece, n_pieces, first_word, past_word[, piece_text]`` of every row; a narrow stage without shuffle.

    ``with_text=False`` leaves the texts inside Python, for callers that need only the cuts.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under the limit")
    keyed = chunks.select(*id_cols, F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(id_cols))
            rows: list[int] = []
            cols: list[list] = [[], [], [], [], []]
            for r in range(b.num_rows):
                text = texts[r].as_py()
                if text is None:
                    continue
                if not with_text and len(quick := text.split()) <= limit:
                    found = [(0, len(quick), 0, 0)] if quick else []
                else:
                    found = pieces_of(text, limit, overlap)
                for k, (a, z, x, y) in enumerate(found):
                    rows.append(r)
                    for col, v in zip(cols, (k, len(found), a, z, text[x:y] if with_text else None), strict=True):
                        col.append(v)
            ids = [b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(id_cols))]
            numbers = [pa.array(c, pa.int32()) for c in cols[:4]]
            yield pa.RecordBatch.from_arrays([*ids, *numbers, *([pa.array(cols[4], pa.string())] if with_text else [])], names=[*id_cols, "piece", "n_pieces", "first_word", "past_word", *(["piece_text"] if with_text else [])])

    fields = [keyed.schema[c] for c in id_cols] + [T.StructField(c, T.IntegerType()) for c in ("piece", "n_pieces", "first_word", "past_word")]
    return keyed.mapInArrow(run, T.StructType(fields + ([T.StructField("piece_text", T.StringType())] if with_text else [])))
