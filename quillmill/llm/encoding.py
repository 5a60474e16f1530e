"""Problem 7: exact byte-level BPE ids of every text, in time linear in its bytes.

Bytes are mapped to Latin-1 so that one Aho-Corasick pass finds every vocabulary entry at every offset of a
pre-token. The ids are built from longest matches; two neighbours are allowed only if the merges, run on their
joined bytes, would give back exactly these two (memoised). Where no choice fits, the last id is taken back and
the offset it started from is marked as dead, so each offset is left at most once.

Null and empty texts have the empty list of ids. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"

#: Pre-token pattern published with the tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, str]:
    """Printable stand-in of each byte in the vocabulary file -> the byte as a Latin-1 character."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): chr(b) for b in printable} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Encoder of one vocabulary; ``memo`` bounds the number of pre-tokens remembered."""

    def __init__(self, tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER, memo: int = 400_000):
        import ahocorasick
        import regex

        with open(os.path.join(tokenizer_dir, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = _byte_alphabet()
        ids = {"".join(plain[c] for c in token): i for token, i in model["vocab"].items() if all(c in plain for c in token)}
        self.ids = ids
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        #: Order in which merges apply; the vocabulary's ids need not follow it.
        self.order: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (ids["".join(plain[c] for c in half)] for half in (left, right))
            whole = ids["".join(plain[c] for c in left + right)]
            self.joined.setdefault((a, b), rank)
            if whole not in self.halves:
                self.halves[whole] = (a, b)
                self.order[whole] = rank
        self.find = ahocorasick.Automaton()
        for token, i in ids.items():
            if token:
                self.find.add_word(token, (len(token), i))
        self.find.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.memo = memo

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave the boundary between these two neighbours uncrossed."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 4 * self.memo:
                self.fits.clear()
            known = self.fits[left, right] = self._boundary_holds(left, right)
        return known

    def _boundary_holds(self, left: int, right: int) -> bool:
        # Undo merges from the latest to the earliest; in between, a merge across the boundary must not have
        # been due before the merge that was undone last.
        due, halves, order = float("inf"), self.halves, self.order
        left_first = False
        while True:
            crossing = self.joined.get((left, right))
            if crossing is not None and (crossing < due or (crossing == due and not left_first)):
                return False
            of_left, of_right = order.get(left, -1), order.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            # With equal ranks the left one is merged first, so the right one is undone first.
            if of_left > of_right:
                due, left, left_first = of_left, halves[left][1], True
            else:
                due, right, left_first = of_right, halves[right][0], False

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ids.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, (length, i) in self.find.iter(raw):
            starts[last + 1 - length].append((last + 1, i))
        dead = bytearray(n + 1)
        out: list[int] = []
        begun: list[int] = []
        tries: list[int] = []
        at, pick = 0, len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while pick >= 0:
                end, i = options[pick]
                if not dead[end] and (not out or self.compatible(out[-1], i)):
                    break
                pick -= 1
            if pick >= 0:
                out.append(i)
                begun.append(at)
                tries.append(pick)
                at = end
                pick = len(starts[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                out.pop()
                at = begun.pop()
                pick = tries.pop() - 1
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; the empty list for null or empty text."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        for p in self.split(text):
            ids = pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(pieces) >= self.memo:
                    pieces.clear()
                if len(p) < 64:
                    pieces[p] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> BytePairEncoder:
    """The worker's encoder, built once."""
    return BytePairEncoder(tokenizer_dir, name)


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row. One narrow Arrow stage, no shuffle; other columns are not read."""
    keyed = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, name)
        for b in batches:
            # Results leave in slices, so that very long texts do not make one huge batch.
            texts, ids, rows = b.column(1), [], 0
            held = 0
            for k in range(b.num_rows):
                got = enc.encode(texts[k].as_py())
                ids.append(got)
                held += len(got)
                if held > 2_000_000 or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(rows, len(ids)), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])
                    rows, ids, held = k + 1, [], 0

    out = T.StructType([keyed.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return keyed.mapInArrow(run, out)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> DataFrame:
    """``(id_col, n_tokens int)`` of every row, without moving the ids out of Python."""
    keyed = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, name)
        for b in batches:
            texts = b.column(1)
            sizes = pa.array([len(enc.encode(texts[k].as_py())) for k in range(b.num_rows)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes], [id_col, "n_tokens"])

    return keyed.mapInArrow(run, T.StructType([keyed.schema[id_col], T.StructField("n_tokens", T.IntegerType())]))


def decode_ids(ids: list[int], tokenizer_dir: str = TOKENIZER_DIR, name: str = TOKENIZER) -> str:
    """The text of a list of ids, for round-trip checks."""
    enc = encoder(tokenizer_dir, name)
    back = {i: t for t, i in enc.ids.items()}
    return "".join(back[i] for i in ids).encode("latin-1").decode("utf-8", "replace")


__all__ = ["BytePairEncoder", "count_tokens", "decode_ids", "encode_corpus", "encoder"]
