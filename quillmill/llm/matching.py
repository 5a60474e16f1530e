"""Problem 3: matching entries of two tables that share no key.

1. Each entry is read once (see citing.py). The graph record - attribute - token of all entries is walked at random, one
   walk through each token of each record, and skip-gram vectors with negative sampling are trained on all walks; tokens
   share the vectors by hash, which bounds the model and not the rows. A token's vector has a second part that tells what
   it looks like (hashed character trigrams), so that misspellings stay near and every token has a vector; tokens are
   weighted by their rarity over all entries.
2. Each entry gets a vector of its title and one of its authors, less the mean over all entries. Signs of random projections of the title or of the authors, joined with the venue's initials and two
   neighbouring years, and of the title with only one of these, are the keys of hash tables; the printed numbers and
   the DOI are keys too.
   Entries that share a key are compared by 63 sign bits, those with equal numbers or DOI are compared at once.
3. What is left is reranked exactly: the cosine of the vectors themselves, and how far titles (letter by letter),
   authors, year, venue and printed numbers agree. These are calibrated to a confidence by a logistic model, which is
   fitted on all pairs that both have a DOI (equal or not), with ``PRIOR`` as the weights that few such pairs fall back to. A pair is a match if its confidence is at least ``LEAST`` and it passes the
   exact check: works of one kind and part of a series, and not with two different DOIs.

Equal entries are represented by one of them until the end. The width of the keys follows the number of entries, so
that buckets keep their size, and the number of tables follows the width, so that recall does; no bucket is capped.

An entry without title, authors and numbers matches nothing. Null in a field means unknown. Ids must be unique
within each table; columns other than those of ``SOURCE`` and ``EXTRACTED`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.citing import COMMON, Entry, read_extracted, read_source
from quillmill.llm.distances import edit_distances
from quillmill.session import unwritten, written

LOOK, BESIDE = 56, 8
DIM = LOOK + BESIDE
#: Rarity of tokens is counted by hash in so many cells, and learned vectors are kept in so many; this bounds what is sent to the workers.
CELLS, LEARNED = 1 << 16, 1 << 18
#: The walks are shared out among so many trainers at most, one for each ``SHARE`` entries, whose models are averaged after
#: each epoch; this bounds what reaches the driver. Walks are trained on in random order of so many at a time.
TRAINERS, SHARE, SHUFFLED = 8, 20_000, 1 << 19
#: A record's tokens that a walk meets, by attribute; bits of an attribute and of a walk's random order.
ATTRIBUTES, ATTRIBUTE_BITS, ORDER_BITS = ("title", "surname", "year", "venue"), 2, 25
#: Tasks at most that sum up the pairs with two DOIs for the calibration, one for each ``SHARE``.
SUMMED = 16
#: Tables of titles and of authors, each with venue and two neighbouring years, so many at the least width of the keys;
#: and of titles with the years or the venue alone, which find pairs that differ in the other. Venue and years together
#: have about 2 ** ``APART`` times as many values as the years, so that these keys need fewer sign bits.
TITLE_TABLES, AUTHOR_TABLES, ALONE_TABLES, APART = 5, 2, 2, 5
#: Least width of a key, and by how much each further bit multiplies the tables: one over the chance that two vectors
#: of cosine 0.9 agree in a bit.
LEAST_WIDTH, MORE_TABLES = 4, 1 / (1 - math.acos(0.9) / math.pi)
#: Bits of a key: each entry holds many keys, and what falls together by chance is told apart by its signs.
KEY_BITS = 40
#: Sign bits of title and authors, together in one long.
T_BITS, P_BITS = 40, 23
#: Weights fitted once on the 1,808 pairs with two DOIs of sf0.1: what the confidence falls back to where such pairs are few.
PRIOR: dict[str, float] = {
    "one": -3.1, "cosine": -0.4, "untitled": 1.4, "authors": 0.2, "people": 1.1, "nobody": 1.1, "same_year": -0.6, "next_year": -2.1, "other_year": -0.3,
    "printed": -1.0, "numbers": 1.6, "all_numbers": 1.6, "strange": -2.2, "venue": -0.7, "kind": 0.5, "part": -1.4, "cut": -2.1, "title_70": 0.5,
    "title_80": 1.1, "title_87": 1.6, "title_93": -0.1, "title_97": 0.4, "title_99": 2.0, "people*like": -0.8, "people*near": 0.7, "people*equal": 1.2,
    "people*untitled": 1.3, "nobody*like": 0.6, "nobody*near": 0.6, "nobody*equal": 0.6, "nobody*untitled": 0.8, "same_year*like": -0.8, "same_year*near":
    1.1, "same_year*equal": -1.9, "same_year*untitled": 1.4, "other_year*like": 0.4, "other_year*near": 0.6, "other_year*equal": 0.1, "venue*like": -1.3,
    "venue*near": 0.4, "venue*equal": -1.3, "venue*untitled": 1.4, "numbers*like": 1.0, "numbers*near": 0.1, "numbers*equal": 0.1, "strange*like": -1.3,
    "strange*near": -1.3, "strange*equal": -1.3, "strange*untitled": -0.7, "kind*like": 1.4, "kind*near": 3.9, "kind*equal": 2.1, "kind*untitled": 1.4,
    "part*like": -1.0, "part*near": 1.4, "part*equal": -0.3, "part*untitled": 1.4, "people*numbers": 1.6, "people*all_numbers": 1.5, "people*venue": 0.5,
    "people*same_year": 1.9, "people*strange": -1.2, "venue*same_year": 1.0, "venue*numbers": 1.0, "all_numbers*like": 1.0,
}
#: Least confidence of a match.
LEAST = 0.5
FEATURES = "words string, kind string, part int, surnames string, year int, numbers string, venue string, doi string"
SOURCE = ("text", "authors", "surname", "title", "year", "doi")
EXTRACTED = ("raw", "authors", "surname", "title", "year", "venue", "volume", "issue", "pages", "doi")


def listed(column: pa.Array) -> list:
    """What ``to_pylist`` gives, of texts, whole numbers and lists of texts; several times as fast."""
    if pa.types.is_list(column.type):
        values, ends = listed(column.flatten()), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        out: list = [values[lo:hi] for lo, hi in zip([0, *ends], ends)]
    elif pa.types.is_integer(column.type):
        out = column.fill_null(0).to_numpy().tolist()
    else:
        return column.to_numpy(zero_copy_only=False).tolist()
    for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)) if column.null_count else ():
        out[i] = None
    return out


def cell_of(token: str, cells: int = CELLS) -> int:
    """Cell of a token; the same as Spark's hash gives."""
    import xxhash

    h = xxhash.xxh64_intdigest(token.encode(), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % cells


def title_tokens(words: str) -> list[str]:
    """Tokens of a title that tell something, letters that are often misread made alike."""
    return [w for w in words.replace("rn", "m").replace("cl", "d").split() if w not in COMMON]


@lru_cache(maxsize=1)
def _trigram_table() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((1 << 14, LOOK)).astype(np.float32)


def sums_of(rows: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows that lists of so many ids name, the lists one after the other: the first ids of all lists are added, then the second ones."""
    out = np.zeros((len(sizes), rows.shape[1]), np.float32)
    starts = np.cumsum(sizes) - sizes
    # A block's sums stay in the cache; its longest lists stand first.
    for lo in range(0, len(sizes), 2048):
        own = sizes[lo : lo + 2048]
        order = np.argsort(-own, kind="stable")
        begins, ends = starts[lo : lo + 2048][order], np.searchsorted(-own[order], -np.arange(int(own.max(initial=0))), side="left")
        block = np.zeros((len(own), rows.shape[1]), np.float32)
        for k, n in enumerate(ends):
            block[:n] += rows.take(ids[begins[:n] + k], axis=0)
        out[lo + order] = block
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """The rows of ``v`` with length 1, in place; zeros stay."""
    v /= np.maximum(np.sqrt(np.einsum("nd,nd->n", v, v)), 1e-9)[:, None]
    return v


def looks(tokens: list[str]) -> np.ndarray:
    """Unit vectors of the tokens' trigrams and of the tokens themselves."""
    import xxhash

    framed = [f"^{t}$" for t in tokens]
    letters = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(p) - 1 for p in framed], np.int64)
    # A trigram begins at each letter but the last two; in place of the last but one stands the token itself.
    ends = np.cumsum(sizes + 1) - 1
    keep = np.ones(len(letters), bool)
    keep[ends] = False
    mixed = (letters[:-2] << np.uint64(42) ^ letters[1:-1] << np.uint64(21) ^ letters[2:]) * np.uint64(0x9E3779B97F4A7C15)
    grams = np.zeros(len(letters), np.int64)
    grams[:-2] = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)
    grams[ends - 1] = [xxhash.xxh32_intdigest(t) & 0x3FFF for t in tokens]
    return unit(sums_of(_trigram_table(), grams[keep], sizes))


def walks(records: list[dict[str, list[str]]], steps: int = 6, seed: int = 5) -> list[list[str]]:
    """Random walks record - attribute - token - attribute - record ...: the tokens met, one walk from each record."""
    rng = np.random.default_rng(seed)
    holders: dict[tuple[str, str], list[int]] = {}
    for i, r in enumerate(records):
        for a, ts in r.items():
            for t in ts:
                holders.setdefault((a, t), []).append(i)
    out = []
    for i in range(len(records)):
        at, path = i, []
        for _ in range(steps):
            attributes = [a for a, ts in records[at].items() if ts]
            if not attributes:
                break
            a = attributes[rng.integers(len(attributes))]
            ts = records[at][a]
            t = ts[rng.integers(len(ts))]
            path.append(t)
            where = holders[a, t]
            at = where[rng.integers(len(where))]
        out.append(path)
    return out


def noise_table(counts: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """Tokens as often as they are drawn as negatives: by the power 0.75 of their counts."""
    noise = np.cumsum(counts.astype(float) ** 0.75)
    return np.searchsorted(noise / noise[-1], (np.arange(size) + 0.5) / size)


def columns_of(model: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``model[:, ids]``, a row at a time."""
    out = np.empty((len(model), *ids.shape), model.dtype)
    for row, x in zip(model, out, strict=True):
        row.take(ids, out=x, mode="clip")
    return out


def descend(centre: np.ndarray, around: np.ndarray, walks: np.ndarray, kept: np.ndarray, noise: np.ndarray, rng: np.random.Generator, negatives: int = 3, rate: float = 0.05, batch: int = 1 << 14, most: int = 16) -> None:
    """One pass of skip-gram with negative sampling over walks (a, token, b), a row each, in place: the pairs of a and token and of a and b, both ways.

    Vectors stand in columns. The pairs of a walk share their negatives. A token that a batch meets more than ``most``
    times moves as far as by so many average steps, lest common ones overshoot.
    """
    size = centre.shape[1]
    for lo in range(0, walks.shape[1], batch):
        a, k, b = w = walks[:, lo : lo + batch].astype(np.intp)
        beside = (kept[a] & kept[k] & (a != k)).astype(np.float32), (kept[a] & kept[b] & (a != b)).astype(np.float32)
        other = np.concatenate([w, noise[rng.integers(0, len(noise), (negatives, w.shape[1]))]])
        vc, vo = columns_of(centre, w), columns_of(around, other)
        gc, go = np.zeros_like(vc), np.zeros_like(vo)
        pairs = [(0, 1, 1, beside[0]), (1, 0, 1, beside[0]), (0, 2, 1, beside[1]), (2, 0, 1, beside[1])]
        pairs += [(i, 3 + j, 0, x) for j in range(negatives) for i, x in enumerate((beside[0] + beside[1], *beside))]
        # Walk by walk nothing is shared but the vectors read, so that blocks that fit the cache give the same.
        for at in range(0, w.shape[1], 1024):
            own = slice(at, at + 1024)
            for i, j, label, weight in pairs:
                c, o = vc[:, i, own], vo[:, j, own]
                g = (label - 1 / (1 + np.exp(-np.clip(np.einsum("dn,dn->n", c, o), -30, 30)))) * (weight[own] * np.float32(rate))
                gc[:, i, own] += g * o
                go[:, j, own] += g * c
        for model, ids, by in ((centre, w.ravel(), gc), (around, other.ravel(), go)):
            by = by.reshape(len(model), -1)
            by *= np.minimum(1, most / np.bincount(ids, minlength=size).take(ids)).astype(np.float32)
            for row, x in zip(model, by, strict=True):
                np.add.at(row, ids, x)


def at_most_unit(centre: np.ndarray, counts: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The learned vectors, in rows, less what all have in common: their part along the mean of all tokens met.

    Longer ones get unit length; those of tokens seldom met stay as short as training left them.
    """
    mean = centre @ (counts * kept / max(1, (counts * kept).sum()))
    mean /= max(np.linalg.norm(mean), 1e-9)
    own = centre - mean[:, None] * (mean @ centre)
    return np.where(kept, own / np.maximum(np.linalg.norm(own, axis=0), 1), 0).T.astype(np.float32)


def skip_gram(paths: list[list[str]], dim: int = BESIDE, epochs: int = 2, least: int = 3, seed: int = 6) -> dict[str, np.ndarray]:
    """Skip-gram vectors with negative sampling of the tokens met at least ``least`` times, of unit length: the whole training in memory."""
    from collections import Counter

    counts = Counter(t for p in paths for t in p)
    vocabulary = sorted(counts)
    index = {t: i for i, t in enumerate(vocabulary)}
    kept = np.array([counts[t] >= least for t in vocabulary], bool)
    triples = [(index[p[i]], index[p[i + 1]], index[p[i + 2 if i + 2 < len(p) else i]]) for p in paths for i in range(len(p) - 1)]
    if kept.sum() < 2 or not triples:
        return {}
    rng = np.random.default_rng(seed)
    centre, around = first_model(len(vocabulary), dim, rng)
    noise = noise_table(np.array([counts[t] for t in vocabulary]) * kept)
    for _ in range(epochs):
        descend(centre, around, rng.permutation(np.array(triples).T, axis=1), kept, noise, rng, batch=512)
    centre /= np.maximum(np.linalg.norm(centre, axis=0), 1e-9)
    return {t: centre[:, i] for t, i in index.items() if kept[i]}


def first_model(size: int, dim: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that training begins with, in columns."""
    return ((rng.random((dim, size)) - 0.5) / dim).astype(np.float32), np.zeros((dim, size), np.float32)


def steps(entries: DataFrame) -> DataFrame:
    """One row for each token of each entry: the token with its attribute, a random order, and what a walker at the entry draws, an attribute and one of its tokens at random, in one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cells: dict[str, int] = {}
        for b in batches:
            if len(cells) > 200_000:
                cells.clear()
            rows = list(zip(*map(listed, b.columns), strict=True))
            held = [(title_tokens(w), n.split(), [f"y{y}"] if y else [], [f"v{v}"] if v else []) for w, n, y, v in rows]
            sizes = np.array([len(ts) for r in held for ts in r], np.int64).reshape(-1, len(ATTRIBUTES))
            met = [t for r in held for ts in r for t in ts]
            if not met:
                continue
            for t in set(met).difference(cells):
                cells[t] = cell_of(t, LEARNED)
            tokens = np.array([cells[t] for t in met], np.int64)
            rng = np.random.default_rng(xxhash.xxh64_intdigest(tokens.tobytes()))
            of = np.repeat(np.arange(len(held)), sizes.sum(1))
            attribute = np.repeat(np.tile(np.arange(len(ATTRIBUTES)), len(held)), sizes.ravel())
            there = np.cumsum(sizes > 0, axis=1)
            drawn = (there[of] <= (rng.random(len(of)) * there[of, -1]).astype(np.int64)[:, None]).sum(1)
            starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
            drawn = tokens[starts[of, drawn] + (rng.random(len(of)) * sizes[of, drawn]).astype(np.int64)]
            order = rng.integers(0, 1 << ORDER_BITS, len(of))
            yield pa.RecordBatch.from_arrays([pa.array(((attribute * LEARNED + tokens) << ORDER_BITS | order) * LEARNED + drawn)], names=["step"])

    return entries.select("words", "surnames", "year", "venue").mapInArrow(run, "step bigint")


def met_walks(entries: DataFrame) -> DataFrame:
    """``(a, token, b)``: the walks of ``walk_blocks``, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, k, b in walks_in(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, k % LEARNED, b)], names=["a", "token", "b"])

    return walk_blocks(entries).mapInArrow(run, "a int, token int, b int")


def walks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The walks of each block, in three rows."""
    for b in batches:
        for x in b.column(0):
            yield np.frombuffer(x.as_buffer(), np.int32).reshape(3, -1)


def walk_blocks(entries: DataFrame) -> DataFrame:
    """``(walks)``: walks record - token - record through each token of each entry, from a token drawn at the entry to one drawn at another holder of the token.

    A row holds the walks of one batch as bytes: those tokens, then the tokens between them with their attributes, then
    the other ones. Row by row they would cost more to write and read than to train on.

    The holders of a token stand in random order, and a walk goes from each to the next, from the last to the first; the
    only holder's walk returns to it.
    """
    low = ORDER_BITS + LEARNED.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = np.empty(0, np.int64), 0
        walk = lambda a, k, b: pa.RecordBatch.from_arrays([pa.array([np.concatenate([a % LEARNED, k, b % LEARNED]).astype(np.int32).tobytes()], pa.binary())], names=["walks"])
        for b in batches:
            x = np.concatenate([last, b.column(0).to_numpy()])
            if not len(x):
                continue
            k = x >> low
            ends = k[1:] != k[:-1]
            # What was drawn at the first holder of each entry's token; the first token may have begun in an earlier batch.
            first = x[np.concatenate([[0], np.flatnonzero(ends) + 1])]
            if len(last):
                first[0] = opened
            group = np.concatenate([[0], np.cumsum(ends)])
            yield walk(x[:-1], k[:-1], np.where(ends, first[group[:-1]], x[1:]))
            last, opened = x[-1:], first[-1]
        if len(last):
            yield walk(last, last >> low, np.array([opened]))

    found = steps(entries)
    return found.repartition(F.shiftright("step", low)).sortWithinPartitions("step").mapInArrow(run, "walks binary")


def summed(rows: DataFrame, tasks: int, add: Callable[[Iterator[pa.RecordBatch]], bytes | None]) -> list[bytes]:
    """What ``add`` makes of the rows of each of at most ``tasks`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = add(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array([got], pa.binary())], names=["got"])

    return [bytes(r.got) for r in rows.coalesce(tasks).mapInArrow(run, "got binary").collect()]


def learned(entries: DataFrame, n: int, epochs: int = 2, least: int = 3, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Skip-gram vectors of all entries' tokens by cell, of unit length at most; zero for a cell met fewer than ``least`` times.

    Also how often the tokens of titles and surnames occur in all entries, by ``CELLS``: a walk goes through each.
    """
    walked = written(walk_blocks(entries))
    trainers = max(1, min(TRAINERS, math.ceil(n / SHARE)))

    def count(batches: Iterator[pa.RecordBatch]) -> bytes:
        out = np.zeros(LEARNED + CELLS, np.int64)
        for a, k, _ in walks_in(batches):
            np.add.at(out, a, 1)
            np.add.at(out, k % LEARNED, 1)
            np.add.at(out, LEARNED + k[k < 2 * LEARNED] % CELLS, 1)
        return out.tobytes()

    counts, rarity = np.split(sum((np.frombuffer(x, np.int64) for x in summed(walked, trainers, count)), np.zeros(LEARNED + CELLS, np.int64)), [LEARNED])
    centre, around = first_model(LEARNED, BESIDE, np.random.default_rng(seed))
    kept = counts >= least
    if not kept.any():
        unwritten(walked)
        return np.zeros((LEARNED, BESIDE), np.float32), rarity
    # Trained are the cells that are kept, and one that stands for all others.
    cells = np.concatenate([np.flatnonzero(~kept)[:1], np.flatnonzero(kept)])
    place = np.zeros(LEARNED, np.int32)
    place[cells] = np.arange(len(cells))
    centre, around, kept_cells = centre[:, cells], around[:, cells], kept[cells]
    noise = noise_table(np.where(kept_cells, counts[cells], 0))
    sent = entries.sparkSession.sparkContext.broadcast
    record = np.dtype([("cell", np.int32), ("n", np.int32), ("centre", np.float16, BESIDE), ("around", np.float16, BESIDE)])
    for epoch in range(epochs):
        model = sent((centre, around, kept_cells, noise, place))

        def train(batches: Iterator[pa.RecordBatch], model=model, epoch=epoch) -> bytes | None:
            centre, around, kept, noise, place = model.value
            size = len(kept)
            new_centre, new_around = centre.copy(), around.copy()
            rng = np.random.default_rng([seed, epoch])
            met = np.zeros(size, np.int64)
            held: list[np.ndarray] = []

            def pass_over() -> None:
                walks = rng.permutation(np.concatenate(held, axis=1), axis=1)
                held.clear()
                np.add(met, np.bincount(walks.ravel(), minlength=size), out=met)
                descend(new_centre, new_around, walks, kept, noise, rng)

            for walks in walks_in(batches):
                held.append(place[walks % LEARNED])
                if sum(x.shape[1] for x in held) >= SHUFFLED:
                    pass_over()
            if held:
                pass_over()
            moved = np.flatnonzero(met)
            out = np.empty(len(moved), record)
            out["cell"], out["n"] = moved, np.minimum(met[moved], np.iinfo(np.int32).max)
            out["centre"], out["around"] = (new_centre - centre)[:, moved].T, (new_around - around)[:, moved].T
            return out.tobytes() if len(moved) else None

        # Averaged by how often each trainer met the cell.
        total, by_centre, by_around = np.zeros(len(cells)), np.zeros_like(centre), np.zeros_like(around)
        for x in summed(walked, trainers, train):
            got = np.frombuffer(x, record)
            weight = got["n"].astype(np.float32)
            total[got["cell"]] += weight
            by_centre[:, got["cell"]] += got["centre"].T * weight
            by_around[:, got["cell"]] += got["around"].T * weight
        centre, around = (v + (by / np.maximum(total, 1)).astype(np.float32) for v, by in ((centre, by_centre), (around, by_around)))
        model.unpersist()
    unwritten(walked)
    every = np.zeros((BESIDE, LEARNED), np.float32)
    every[:, cells] = centre
    return at_most_unit(every, counts, kept), rarity


class Embedder:
    """Vectors of token lists, weighted by rarity, less the mean vectors of titles and authors."""

    def __init__(self, beside: np.ndarray, counts: np.ndarray, means: np.ndarray | None = None):
        self.beside, self.counts = beside, counts
        self.means = np.zeros((2, DIM), np.float32) if means is None else means
        self.total = max(1.0, float(counts.sum()))
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, DIM), np.float32)

    def _meet(self, tokens: list[str]) -> None:
        """Rows of tokens not met before."""
        at = len(self.index)
        self.index.update(zip(tokens, range(at, at + len(tokens)), strict=True))
        if len(self.index) > len(self.rows):
            self.rows = np.concatenate([self.rows[:at], np.empty((len(self.index), DIM), np.float32)])
        cells = np.array([cell_of(t, LEARNED) for t in tokens])
        # Misspelt tokens are rare too; the floor keeps them from outweighing all others.
        w = np.log(1 + self.total / (self.total / 5e4 + 20 + self.counts[cells % CELLS]))[:, None]
        new = self.rows[at : at + len(tokens)]
        new[:, :LOOK] = looks(tokens) * w
        new[:, LOOK:] = self.beside[cells] * (0.5 * w) if len(self.beside) else 0

    def lists(self, lists: list[list[str]], kind: int) -> np.ndarray:
        """One unit vector for each list; zero for an empty one. ``kind``: 0 for titles, 1 for authors."""
        if len(self.index) > 250_000:
            self.index.clear()
        out = np.zeros((len(lists), DIM), np.float32)
        full = [i for i, ts in enumerate(lists) if ts]
        if full:
            tokens = [t for i in full for t in lists[i]]
            get = self.index.get
            ids = np.array([get(t, -1) for t in tokens], np.int64)
            if len(missed := np.flatnonzero(ids < 0)):
                self._meet(list(dict.fromkeys(tokens[i] for i in missed)))
                ids[missed] = [get(tokens[i]) for i in missed]
            x = unit(sums_of(self.rows, ids, np.array([len(lists[i]) for i in full], np.int64)))
            x -= self.means[kind]
            out[full] = unit(x)
        return out


def _packed(x: np.ndarray, planes: list[np.ndarray]) -> list[np.ndarray]:
    """Signs of the projections on each set of planes, at most 64, as int64."""
    sizes = [-(-p.shape[1] // 8) * 8 for p in planes]
    every = np.zeros((x.shape[1], sum(sizes)), np.float32)
    for at, p in zip(np.cumsum(sizes) - sizes, planes, strict=True):
        every[:, at : at + p.shape[1]] = p
    bits = np.packbits((x @ every > 0).ravel(), bitorder="little").reshape(len(x), -1)
    out = []
    for at, size in zip((np.cumsum(sizes) - sizes) // 8, sizes, strict=True):
        own = np.zeros((len(x), 8), np.uint8)
        own[:, : size // 8] = bits[:, at : at + size // 8]
        out.append(own.view("<i8").ravel())
    return out


def key_width(n: int) -> int:
    """Sign bits of a key for n entries: one more for each doubling, so that buckets keep their size."""
    return max(LEAST_WIDTH, round(math.log2(max(n, 1))) - 10)


def tables_of(width: int) -> tuple[int, int, int]:
    """Width of the keys with venue and years, and how many tables they have of titles and of authors: so many more for
    wider keys that two near vectors share one of them as often as at the least width."""
    near = max(LEAST_WIDTH, width - APART)
    more = MORE_TABLES ** (near - LEAST_WIDTH)
    return near, math.ceil(TITLE_TABLES * more), math.ceil(AUTHOR_TABLES * more)


def fit(source_refs: DataFrame, extracted_refs: DataFrame, n: int) -> Embedder:
    """Rarity, skip-gram vectors and means over all rows."""
    return fitted(both(source_refs, extracted_refs), n)


def fitted(entries: DataFrame, n: int) -> Embedder:
    """The embedder of parsed entries, of which there are ``n``."""
    beside, rarity = learned(entries, n)
    return Embedder(beside, rarity, mean_vectors(entries, Embedder(beside, rarity)))


def mean_vectors(entries: DataFrame, raw: Embedder) -> np.ndarray:
    """Means over all entries of the vectors of titles and of authors, those of entries without any left out; one row a task reaches the driver."""
    embedder = shared(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, out = embedder(), np.zeros((2, DIM + 1))
        for b in batches:
            words, names = map(listed, b.columns)
            for kind, lists in enumerate(([title_tokens(w) for w in words], [x.split() for x in names])):
                out[kind, :DIM] += embed.lists(lists, kind).sum(0, dtype=float)
                out[kind, DIM] += sum(map(bool, lists))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["got"])

    total = np.zeros((2, DIM + 1))
    for r in entries.select("words", "surnames").mapInArrow(run, "got binary").collect():
        total += np.frombuffer(bytes(r.got)).reshape(total.shape)
    return (total[:, :DIM] / np.maximum(total[:, DIM:], 1)).astype(np.float32)


_EMBEDDERS: dict[str, Embedder] = {}


def shared(embedder: Embedder) -> Callable[[], Embedder]:
    """Gives the worker's embedder, built once, with the tokens it has met."""
    import hashlib

    beside, counts, means = embedder.beside, embedder.counts, embedder.means
    digest = hashlib.sha256(np.asarray(beside).tobytes() + counts.tobytes()).hexdigest() if len(beside) else hashlib.sha256(counts.tobytes()).hexdigest()

    def get() -> Embedder:
        if digest not in _EMBEDDERS:
            _EMBEDDERS.clear()
            _EMBEDDERS[digest] = Embedder(beside, counts)
        _EMBEDDERS[digest].means = means
        return _EMBEDDERS[digest]

    return get


def parsed(rows: DataFrame, id_col: str, columns: tuple[str, ...], side: int) -> DataFrame:
    """``(id, side, features)`` of every row, in one narrow Arrow stage."""
    read = read_source if side == 0 else read_extracted
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(*r) for r in zip(*map(listed, b.columns[1:]), strict=True)]
            features = [pa.array([getattr(e, f) for e in got], kind) for f, kind in zip(Entry.__slots__, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([side] * len(got), pa.int32()), *features], names=["id", "side", *Entry.__slots__])

    return rows.select(F.col(id_col).cast("long").alias("id"), *columns).mapInArrow(run, f"id bigint, side int, {FEATURES}")


def both(source_refs: DataFrame, extracted_refs: DataFrame) -> DataFrame:
    """The parsed entries of both tables."""
    return parsed(source_refs, "ref_id", SOURCE, 0).unionByName(parsed(extracted_refs, "ext_id", EXTRACTED, 1))


def read_entries(rows: DataFrame, id_col: str, columns: tuple[str, ...], side: int, embedder: Embedder, width: int) -> DataFrame:
    """``(id, side, features, signs, keys)`` of every row."""
    return keyed(parsed(rows, id_col, columns, side), embedder, width)


def keyed(entries: DataFrame, embedder: Embedder, width: int) -> DataFrame:
    """Parsed entries with their signs and keys, in one narrow Arrow stage."""
    embed_of = shared(embedder)
    rng = np.random.default_rng(23)
    near, by_title, by_authors = tables_of(width)
    # (what is hashed, with what, sign bits): half of the tables with years pair a year with the one before, half with the one after.
    plan = [("title", f"both{k % 2}", near) for k in range(by_title)] + [("authors", f"both{k % 2}", near) for k in range(by_authors)]
    plan += [("title", f"years{k % 2}", width) for k in range(ALONE_TABLES)] + [("title", "venue", width) for _ in range(ALONE_TABLES)]
    planes = [rng.standard_normal((DIM, w)).astype(np.float32) for _, _, w in plan]
    signs = rng.standard_normal((2, DIM, T_BITS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        embed = embed_of()
        mix = np.uint64(0x9E3779B97F4A7C15)

        @lru_cache(maxsize=100_000)
        def number_of(text: str) -> int:
            return xxhash.xxh64_intdigest(text) >> 1

        def key(table: int, codes: np.ndarray, other: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                h = (codes.astype(np.uint64) + np.uint64(table) * np.uint64(1 << 40)) * mix ^ other.astype(np.uint64)
                # The last bit tells numbers and DOIs from the others.
                return ((h ^ (h >> np.uint64(29))) * mix >> np.uint64(64 - KEY_BITS) & ~np.uint64(1)).view(np.int64)

        for b in batches:
            if not b.num_rows:
                continue
            words, surnames, years, numbers, venues, dois = (listed(b.column(c)) for c in ("words", "surnames", "year", "numbers", "venue", "doi"))
            tokens, names = [title_tokens(w) for w in words], [n.split() for n in surnames]
            t, p = embed.lists(tokens, 0), embed.lists(names, 1)
            titled, named = np.array([bool(w) for w in tokens]), np.array([bool(x) for x in names])
            year = np.array([y or 0 for y in years], np.int64)
            venue = np.array([number_of(v) if v else 0 for v in venues], np.int64)
            cols, valid = [], []
            *by_t, signs_t = _packed(t, [*(x for x, (what, _, _) in zip(planes, plan, strict=True) if what == "title"), signs[0]])
            *by_p, signs_p = _packed(p, [*(x for x, (what, _, _) in zip(planes, plan, strict=True) if what == "authors"), signs[1][:, :P_BITS]])
            codes = {"title": iter(by_t), "authors": iter(by_p)}
            years = [np.where(year != 0, (year + k) // 2, 0) for k in (0, 1)]
            others = {"venue": (venue, venue != 0)}
            for k in (0, 1):
                others[f"years{k}"] = (years[k], year != 0)
                # A missing venue is a value like others: it may be missing in both.
                others[f"both{k}"] = (venue ^ (years[k] << np.int64(40)), year != 0)
            for k, (what, beside_it, _) in enumerate(plan):
                other, there = others[beside_it]
                cols.append(key(k, next(codes[what]), other))
                valid.append((titled if what == "title" else named) & there)
            cols.append(np.array([number_of("n" + x) & (1 << KEY_BITS) - 1 | 1 for x in numbers], np.int64))
            valid.append(np.array([x.count(" ") >= 2 for x in numbers]))
            cols.append(np.array([number_of("d" + x) & (1 << KEY_BITS) - 1 | 1 for x in dois], np.int64))
            valid.append(np.array([x != "" for x in dois]))
            keep, flat = np.stack(valid, 1), np.stack(cols, 1)
            offsets = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
            looks_like = (signs_t << np.int64(P_BITS)) | signs_p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(looks_like), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[keep]))], names=[*b.schema.names, "signs", "keys"])

    schema = T.StructType([*entries.schema.fields, T.StructField("signs", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return entries.mapInArrow(run, schema)


def candidates(entries: DataFrame) -> DataFrame:
    """``(s, e)``: distinct pairs of entries of the two sides that share a key and look alike by their sign bits."""
    once = entries.select("side", "fid", "words", "surnames", "signs", "keys").dropDuplicates(["side", "fid"])
    return sharing_keys(*(once.filter(F.col("side") == k) for k in (0, 1)))


def sharing_keys(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """``candidates`` of two tables of distinct entries."""
    # Without the texts, which would be copied for each key.
    narrow = lambda d, fid, sg, ti, na: d.select("keys", F.col("fid").alias(fid), F.col("signs").alias(sg), (F.col("words") != "").alias(ti), (F.col("surnames") != "").alias(na))
    placed = lambda d, *names: narrow(d, *names).select(F.explode("keys").alias("key"), *names)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    far_t, far_p = F.bit_count(F.shiftright(differ, P_BITS)), F.bit_count(differ.bitwiseAND(F.lit((1 << P_BITS) - 1)))
    both, people = F.col("ta") & F.col("tb"), F.col("pa") & F.col("pb")
    # Entries without authors have no signs of them: then the title alone tells.
    near = F.when(both & people, ((far_t <= 8) & (far_p <= 10)) | ((far_t <= 11) & (far_p <= 8)) | (far_t <= 6) | ((far_p <= 5) & (far_t <= 16))).when(both, far_t <= 11).otherwise(people & (far_p <= 5))
    # Equal volume, issue and pages, or DOI, need no likeness besides.
    near = near | (F.col("key").bitwiseAND(F.lit(1)) == 1)
    return placed(source, "s", "a", "ta", "pa").join(placed(extracted, "e", "b", "tb", "pb"), "key").filter(near).select("s", "e").repartition("s").distinct()


def with_cosine(pairs: DataFrame, embedder: Embedder) -> DataFrame:
    """``pairs``, that hold (s_words, s_names, e_words, e_names), with the cosine of the vectors themselves instead: of the titles if both entries have one, else of the authors."""
    embed_of = shared(embedder)
    texts = ("s_words", "s_names", "e_words", "e_names")
    kept = [f for f in pairs.schema.fields if f.name not in (*texts, "cosine")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = embed_of()
        for b in batches:
            st, sn, et, en = (listed(b.column(c)) for c in texts)
            titled = np.array([bool(a and c) for a, c in zip(st, et, strict=True)], bool)
            cosine = np.zeros(len(titled), np.float32)
            for which, kind, read, sides in ((titled, 0, title_tokens, (st, et)), (~titled, 1, str.split, (sn, en))):
                rows = np.flatnonzero(which)
                a, c = (embed.lists([read(x[i]) for i in rows], kind) for x in sides)
                cosine[rows] = np.einsum("nd,nd->n", a, c)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(cosine, pa.float32())], names=[*(f.name for f in kept), "cosine"])

    return pairs.mapInArrow(run, T.StructType([*kept, T.StructField("cosine", T.FloatType())]))


def exact_cosine(pairs: DataFrame, entries: DataFrame, embedder: Embedder) -> DataFrame:
    """Pairs (s, e, doi, same) with the exact cosine of their entries."""
    side = lambda k, name: entries.filter(F.col("side") == k).select(F.col("fid").alias(name), F.col("words").alias(f"{name}_words"), F.col("surnames").alias(f"{name}_names")).dropDuplicates([name])
    return with_cosine(pairs.select("s", "e", "doi", "same").join(side(0, "s"), "s").join(side(1, "e"), "e"), embedder)


def title_letters(words: str) -> str:
    """Letters and digits of a title, the common misreadings undone."""
    return words.replace("0", "o").replace("1", "l").replace(" ", "").replace("rn", "m").replace("cl", "d")


def title_agreement(a: list[str], b: list[str]) -> np.ndarray:
    """1 less the share of letters to change; a title cut short is held against the front or back of the other. NaN if there is none on a side.

    A title that lacks a few letters in one place, and is else the same, counts as 0.9.
    """
    sizes = np.array([list(map(len, a)), list(map(len, b))]).reshape(2, -1)
    long, short = sizes.max(0), sizes.min(0)
    changes, front, back = edit_distances(a, b, 14)
    whole = 1 - changes / np.maximum(long, 1)
    ends = 1 - np.minimum(front, back) / np.maximum(short, 1) - 0.02
    gap = np.where((changes <= long - short + 2) & (long - short <= 14) & (long - short >= 4) & (short >= 25), 0.9, 0.0)
    return np.where(short == 0, np.nan, np.where(short >= 14, np.maximum(np.maximum(whole, ends), gap), whole))


def with_titles(pairs: DataFrame) -> DataFrame:
    """``pairs``, that hold s_words, e_words, s_numbers and e_numbers, with the agreement of their titles and by how many letters the first is longer: those that ``may_match``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, e = ([title_letters(w) for w in listed(b.column(c))] for c in ("s_words", "e_words"))
            title = title_agreement(s, e)
            kept = ~(title < 0.55)
            numbers = [listed(b.column(c)) for c in ("s_numbers", "e_numbers")]
            for i in np.flatnonzero(~kept):
                x, y = (n[i].split() for n in numbers)
                kept[i] = len(x) >= 3 and len(y) >= 2 and len(own := set(x)) >= 3 and len(own.intersection(y)) >= len(own) - 1
            longer = np.array([len(x) - len(y) for x, y in zip(s, e, strict=True)], np.int32)
            found = pa.RecordBatch.from_arrays([*b.columns, pa.array(title, from_pandas=True), pa.array(longer)], names=[*b.schema.names, "title", "longer"])
            yield found.filter(pa.array(kept))

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("title", T.DoubleType()), T.StructField("longer", T.IntegerType())]))


def agreements(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Each candidate pair that may match, with what its entries agree in."""
    cols = ("words", "kind", "part", "surnames", "year", "numbers", "venue", "doi")
    side = lambda k, name, p: entries.filter(F.col("side") == k).select(F.col("fid").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in cols)).dropDuplicates([name])
    x = with_titles(pairs.join(side(0, "s", "s"), "s").join(side(1, "e", "e"), "e"))
    for p in ("s", "e"):
        x = x.withColumn(f"{p}_names", F.col(f"{p}_surnames"))
        for c in ("surnames", "numbers"):
            x = x.withColumn(f"{p}_{c}", F.filter(F.split(f"{p}_{c}", " "), lambda w: w != ""))
    shared = F.size(F.array_intersect("s_surnames", "e_surnames"))
    close = F.exists("s_surnames", lambda u: F.exists("e_surnames", lambda v: F.levenshtein(u, v, 2) >= 0))
    common = F.size(F.array_intersect("s_numbers", "e_numbers"))
    return x.select(
        "s", "e", "s_words", "s_names", "e_words", "e_names", "title", "longer",
        (F.col("s_kind") == F.col("e_kind")).alias("same_kind"),
        F.col("s_kind").alias("kind"), F.col("s_part").alias("s_part"), F.col("e_part").alias("e_part"),
        (shared / F.greatest(F.lit(1), F.least(F.size("s_surnames"), F.size("e_surnames")))).alias("authors"), close.alias("close_author"), F.size("s_surnames").alias("n_authors"),
        F.abs(F.col("s_year") - F.col("e_year")).alias("years"),
        F.size(F.array_distinct("s_numbers")).alias("n_numbers"), common.alias("numbers"),
        (F.col("s_venue") == F.col("e_venue")).alias("venue"),
        F.when((F.col("s_doi") != "") & (F.col("e_doi") != ""), F.col("s_doi") == F.col("e_doi")).alias("doi"),
    )


def evidence() -> dict[str, Column]:
    """What the confidence is made of, as numbers: of agreements and the exact cosine. An unknown agreement is 0."""
    c = F.col
    title, there = F.coalesce(c("title"), F.lit(0.0)), c("title").isNotNull()
    yes = lambda b: F.coalesce(b, F.lit(False)).cast("double")
    printed = c("n_numbers") >= 3
    base = {
        "authors": F.coalesce(c("authors"), F.lit(0.0)), "people": yes((c("authors") >= 0.5) | c("close_author")), "nobody": yes(c("n_authors") <= 0),
        "same_year": yes(c("years") == 0), "next_year": yes(c("years") == 1), "other_year": yes(c("years") > 1), "no_year": yes(c("years").isNull()),
        "printed": yes(printed), "numbers": yes(printed & (c("numbers") >= c("n_numbers") - 1)), "all_numbers": yes(all_numbers()), "strange": yes(printed & (c("numbers") <= 1)),
        "venue": yes(c("venue")), "kind": yes(c("same_kind")), "part": yes(same_part()), "cut": F.least(F.abs(c("longer")), F.lit(30)) / 30.0,
    }
    out = {"one": F.lit(1.0), "cosine": F.coalesce(c("cosine").cast("double"), F.lit(0.0)), "untitled": yes(~there)} | base
    for k in (60, 70, 80, 87, 93, 97, 99):
        out[f"title_{k}"] = F.when(there, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (title - k / 100) / (1 - k / 100)))).otherwise(F.lit(0.0))
    levels = {"like": yes(title >= 0.6), "near": yes(title >= 0.87), "equal": yes(title >= 0.95), "untitled": yes(~there)}
    for name in ("people", "nobody", "same_year", "other_year", "venue", "numbers", "strange", "kind", "part"):
        for level, b in levels.items():
            out[f"{name}*{level}"] = base[name] * b
    for x, y in (("people", "numbers"), ("people", "all_numbers"), ("people", "venue"), ("people", "same_year"), ("people", "strange"), ("numbers", "other_year"), ("venue", "same_year"), ("venue", "numbers")):
        out[f"{x}*{y}"] = base[x] * base[y]
    out["all_numbers*like"] = base["all_numbers"] * levels["like"]
    return out


def all_numbers() -> Column:
    """Volume, issue and both pages agree: a derived work has numbers of its own."""
    return (F.col("n_numbers") >= 4) & (F.col("numbers") >= 4)


def same_part() -> Column:
    """The same part of a series, or a title that is cut short before its part."""
    c = F.col
    return (c("s_part") == c("e_part")) | ((c("s_part") == 0) & (c("longer") < -2)) | ((c("e_part") == 0) & (c("longer") > 2))


def may_match() -> Column:
    """Pairs worth the exact cosine: titles alike at all, or one missing, or equal printed numbers."""
    numbers = (F.col("n_numbers") >= 3) & (F.col("numbers") >= F.col("n_numbers") - 1)
    return F.coalesce(F.col("title") >= 0.55, F.lit(True)) | numbers


def one_work() -> Column:
    """The exact check: corrections, replies and other parts of a series are works of their own, and so are two DOIs."""
    return ((F.col("same_kind") & same_part()) | all_numbers()) & F.coalesce(F.col("doi"), F.lit(True))


def calibration(pairs: DataFrame, names: list[str], strength: float = 0.1) -> np.ndarray:
    """Weights of the evidence, fitted on all pairs with two DOIs; the fewer there are, the nearer to ``PRIOR``.

    ``pairs``: (s, e, doi, evidence). The labels are whether the DOIs are equal. Each step of Newton's method sums its
    gradient and curvature over the pairs where they are.
    """
    known = written(pairs.filter(F.col("doi").isNotNull()).select("evidence", "doi"))
    tasks = max(1, min(SUMMED, math.ceil(known.count() / SHARE)))
    prior = np.array([PRIOR.get(k, 0.0) for k in names])
    w, size = prior.copy(), len(names)
    for _ in range(60):

        def add(batches: Iterator[pa.RecordBatch], w=w) -> bytes:
            out = np.zeros((size + 1, size))
            for b in batches:
                x, y = b.column(0).flatten().to_numpy().reshape(-1, size), b.column(1).to_numpy(zero_copy_only=False).astype(float)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                out[:size] += (x * (p * (1 - p) + 1e-6)[:, None]).T @ x
                out[size] += x.T @ (p - y)
            return out.tobytes()

        total = sum((np.frombuffer(x).reshape(size + 1, size) for x in summed(known, tasks, add)), np.zeros((size + 1, size)))
        step = np.linalg.solve(total[:size] + strength * np.eye(size), total[size] + strength * (w - prior))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-5:
            break
    unwritten(known)
    return w


def matches(source_refs: DataFrame, extracted_refs: DataFrame) -> DataFrame:
    """``(ref_id, ext_id, confidence)`` of every pair of entries of the same work."""
    # Equal entries have one number: what a third of all rows may be copies of is compared once.
    entries = written(both(source_refs, extracted_refs).withColumn("fid", F.xxhash64("words", "kind", "part", "surnames", F.coalesce("year", F.lit(-1)), "numbers", "venue", "doi")))
    n = entries.count()
    embedder, width = fitted(entries, n), key_width(n)
    once = [entries.filter(F.col("side") == k).select("fid", "words", "surnames", "year", "numbers", "venue", "doi").dropDuplicates(["fid"]) for k in (0, 1)]
    features = evidence()
    judged = with_cosine(agreements(sharing_keys(*(keyed(d, embedder, width) for d in once)), entries).filter(may_match()), embedder)
    pairs = written(judged.select("s", "e", "doi", one_work().alias("fits"), F.array(*features.values()).alias("evidence")))
    weights = calibration(pairs, list(features))
    score = F.aggregate(F.zip_with("evidence", F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    found = pairs.filter("fits").select("s", "e", (1 / (1 + F.exp(-score))).alias("confidence")).filter(F.col("confidence") >= LEAST)
    of = lambda k, name, row: entries.filter(F.col("side") == k).select(F.col("fid").alias(name), F.col("id").alias(row))
    return found.select("s", "e", "confidence").join(of(0, "s", "ref_id"), "s").join(of(1, "e", "ext_id"), "e").select("ref_id", "ext_id", "confidence")
