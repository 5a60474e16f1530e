"""Problem 1: linking the spellings of one person's or organisation's name.

Names are parsed into an anchor (surname or place), given names or topics, and a kind. The distinct anchors, not the
rows, go through a prefix-filtered set-similarity join on q-grams: each anchor sends out only its rarest q-grams, so
many that two anchors at one edit must share one, and pairs that do are verified by a soft token similarity in which
rare tokens count more. A rarer spelling goes to the commonest one it matches.

Within an anchor, spellings are assigned to entities: full given names (short forms by table, typing errors by the
corpus's own vocabulary) are entities; initials and shortened names go to the entity that fits them. Only distinct
forms, cleaned of errors, are compared, never rows.

Rows without a name are in no entity; a null in any field is an empty field; ids must be unique over both tables.
Names of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.names import FORMAL, KINDS, PARTICLES, TITLES, Vocabulary, one_edit, parse
from quillmill.session import cut, written

#: Rarity of q-grams is counted by hash, in so many cells; this bounds what is sent to the workers.
GRAM_CELLS = 1 << 17
#: A word is common if it makes up one in so many names; there can be no more such words than this times the words a name.
COMMON = 20_000
#: A given name likewise, of the names.
GIVEN = 5_000
BLOCK = 512
#: Particles that are run together with surnames (fixed values).
JOINED = ("vander", "vonder", "van", "von", "dela", "de", "al", "ten")


def typed_names(creators: DataFrame, source_refs: DataFrame) -> DataFrame:
    """``(row_id, last, first, single)`` of both tables; a first author by whole name, else by surname."""
    whole = F.get(F.col("authors"), 0)
    return creators.select(F.col("creator_id").cast("long").alias("row_id"), F.col("last_name").alias("last"), F.col("first_name").alias("first"), F.col("name").alias("single")).unionByName(
        source_refs.select(F.col("ref_id").cast("long").alias("row_id"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("first"), F.coalesce(F.when(F.trim(whole) != "", whole), F.col("surname")).alias("single"))
    )


def common_words(names: DataFrame, least: int = 4) -> tuple[dict[str, int], dict[str, int]]:
    """Common words of all names, and those of them that stand mostly in the given-name field; both bounded by ``COMMON``."""
    n = names.count()

    def words(c: str, field: int):
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0))
        return F.transform(found, lambda w: F.struct(w.alias("w"), F.lit(field).alias("f")))

    tagged = names.select(F.explode(F.concat(words("last", 1), words("first", 2), words("single", 0))).alias("x"))
    counts = tagged.groupBy("x.w").agg(F.count("*").alias("n"), F.count_if(F.col("x.f") == 1).alias("l"), F.count_if(F.col("x.f") == 2).alias("g")).filter(F.col("n") >= max(least, n // COMMON)).collect()
    everything = {r.w: r.n for r in counts}
    given = {r.w: r.g for r in counts if r.g > 3 * r.l and r.g >= max(least, n // GIVEN) and r.w not in PARTICLES and r.w not in TITLES}
    return everything, given


_VOCABULARIES: dict[str, tuple[Vocabulary, Vocabulary, Vocabulary]] = {}


def _vocabularies(digest: str, everything: dict[str, int], given: dict[str, int]) -> tuple[Vocabulary, Vocabulary, Vocabulary]:
    """Given names, kinds and all words, built once in each worker."""
    if digest not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[digest] = Vocabulary(given | {w: given.get(w, 1) for w in FORMAL}, frozenset(FORMAL)), Vocabulary(dict.fromkeys(KINDS, 1)), Vocabulary(everything)
    return _VOCABULARIES[digest]


def parse_names(names: DataFrame, everything: dict[str, int], given: dict[str, int]) -> DataFrame:
    """``(row_id, org, anchor, kind, rest)``: errors in given names, kinds and topics are corrected by the vocabularies."""

    digest = hashlib.sha256(repr((sorted(everything.items()), sorted(given.items()))).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds, words = _vocabularies(digest, everything, given)
        read = lru_cache(maxsize=50_000)(lambda last, first, single: parse(last, first, single, known))

        def person_part(t: str) -> str:
            if t.endswith("."):
                return t
            t = t if t in FORMAL else known.nearest(t) or t
            formal = FORMAL.get(t, (t,))
            return formal[0] if len(formal) == 1 else "?" + t

        for b in batches:
            ids, org, anchor, kind, rest = [], [], [], [], []
            for row_id, last, first, single in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = read(last, first, single)
                if n is None:
                    continue
                ids.append(row_id)
                org.append(n.org)
                anchor.append(" ".join(n.anchor))
                if n.org:
                    k = kinds.nearest(n.kind) or n.kind
                    kind.append("centre" if k == "center" else k)
                    rest.append([t if t.endswith(".") else words.nearest(t) or t for t in n.rest])
                else:
                    kind.append("")
                    rest.append([person_part(t) if i == 0 else t[0] for i, t in enumerate(n.rest[:2])])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(org, pa.bool_()), pa.array(anchor, pa.string()), pa.array(kind, pa.string()), pa.array(rest, pa.list_(pa.string()))], names=["row_id", "org", "anchor", "kind", "rest"])

    return names.mapInArrow(run, "row_id bigint, org boolean, anchor string, kind string, rest array<string>")


def gram_classes(token: str, edits: int = 1) -> list[tuple[int, list[str]]]:
    """(q, distinct q-grams) for each length class of a token; lengths that differ by so many edits share a class."""
    n = len(token)
    padded = f"^{token}$"
    out = []
    # With two edits the classes overlap by one more.
    for q, lo, hi in ((2, 1, 5 + edits), (3, 6, 8 + edits), (4, 9, 1 << 30)):
        if lo <= n <= hi:
            out.append((q, sorted({padded[i : i + q] for i in range(max(1, len(padded) - q + 1))})))
    return out


def prefix(grams: list[str], q: int, order: list[int], edits: int = 1) -> list[str]:
    """The rarest grams, so many that a token at so many edits shares at least one of its own rarest with them.

    One edit, a swap of neighbours included, changes at most q + 1 grams.
    """
    return sorted(grams, key=lambda g: (order[_cell(g)], g))[: edits * (q + 1) + 1]


def _cell(gram: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(gram) % GRAM_CELLS


def same_anchor(x: list[str], y: list[str], weight: dict[str, float], least: float) -> bool:
    """Soft token similarity of two anchors; of different numbers of words they are compared run together."""
    if len(x) != len(y):
        x, y = ["".join(x)], ["".join(y)]
    return soft_similarity(x, y, weight) >= least


def soft_similarity(a: list[str], b: list[str], weight: dict[str, float] | None = None) -> float:
    """Share of the tokens' weight that has a partner, times the partners' likeness; rare tokens weigh more."""

    def one_way(x: list[str], y: list[str]) -> tuple[float, float]:
        got = total = 0.0
        for t in x:
            w = weight.get(t, 1.0) if weight else 1.0
            best = max((1.0 if t == u else 1 - 1 / max(len(t), len(u)) if one_edit(t, u) else 0.0 for u in y), default=0.0)
            got, total = got + w * best, total + w
        return got, total

    (g1, t1), (g2, t2) = one_way(a, b), one_way(b, a)
    return (g1 + g2) / (t1 + t2) if t1 + t2 else 0.0


def anchor_links(anchors: DataFrame, least_similarity: float = 0.75) -> DataFrame:
    """``(anchor, target)`` for anchors that go to a commoner spelling, from ``(anchor, n)``, distinct."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for a in b.column(0).to_pylist():
                for _, grams in gram_classes(a):
                    seen.update(map(_cell, grams))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["cell", "n"])

    order = [0] * GRAM_CELLS
    for r in anchors.select("anchor").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        order[r.cell] = r.n
    # How often each word of an anchor is written, over all rows; rare words weigh more.
    words = anchors.select(F.explode(F.split("anchor", " ")).alias("w"), "n").groupBy(F.pmod(F.xxhash64("w"), F.lit(GRAM_CELLS)).cast("int").alias("cell")).agg(F.sum("n").alias("n"))
    written_words = {r.cell: r.n for r in words.collect()}
    total = sum(written_words.values()) or 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows = []
            for a, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # Every word may have an error of its own.
                edits = 1 + ("\x20" in a)
                for q, grams in gram_classes(a, edits):
                    rows += [(xxhash.xxh64_intdigest(f"{q}{g}") >> 1, a, n) for g in prefix(grams, q, order, edits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["gram", "a", "n"])

    # The key holds the length, so that a list of a gram holds words of one length only; the longer word of a pair
    # goes to the lists of the lengths that it may have lost letters from.
    sent = cut(anchors.select("anchor", "n").mapInArrow(send, "gram bigint, a string, n bigint"))
    shorter = F.when(F.col("a").contains(" "), 2).otherwise(1)
    near = sent.select("gram", "a", "n", F.explode(F.sequence(F.length("a") - shorter, F.length("a"))).alias("size"))
    far = sent.select("gram", F.col("a").alias("b"), F.col("n").alias("m"), F.length("a").alias("size"))
    several = F.col("a").contains(" ") & F.col("b").contains(" ")
    # Bounded edit distances: the computation stops at the bound.
    few = F.when(several, F.levenshtein("a", "b", 4) >= 0).otherwise(F.levenshtein("a", "b", 2) >= 0)
    close = near.join(far, ["gram", "size"]).filter((F.col("a") != F.col("b")) & few)
    up = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") > F.col("a")))
    pairs = close.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("n", "m").alias("m")).distinct()
    # A particle run together with the surname, where the surname alone is there too.
    bare = anchors.select(F.col("anchor").alias("a"), "n", F.regexp_extract("anchor", f"^(?:{'|'.join(sorted(JOINED, key=len, reverse=True))})(.{{4,}})$", 1).alias("b")).filter("b <> ''")
    bare = bare.join(anchors.select(F.col("anchor").alias("b"), F.col("n").alias("m")), "b").filter("m >= n").select(F.col("a").alias("anchor"), F.col("b").alias("target"), "m")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def weight(t: str) -> float:
            h = xxhash.xxh64_intdigest(t.encode(), seed=42)
            return math.log(1 + total / written_words.get((h - (1 << 64) if h >> 63 else h) % GRAM_CELLS, 1))

        for b in batches:
            keep = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tx, ty = x.split(), y.split()
                keep.append(same_anchor(tx, ty, {t: weight(t) for t in tx + ty}, least_similarity))
            yield b.filter(pa.array(keep, pa.bool_()))

    best = pairs.mapInArrow(verify, "a string, b string, m bigint").select(F.col("a").alias("anchor"), F.col("b").alias("target"), "m")
    best = best.unionByName(bare).groupBy("anchor").agg(F.max_by("target", F.struct("m", "target")).alias("target"))
    # Counts never fall along a chain. Doubled until no target changes; chains have no more steps than there are links,
    # which ends it too where equally common spellings go round in a ring.
    best = cut(best)
    for _ in range(best.count().bit_length()):
        nxt = best.select(F.col("anchor").alias("target"), F.col("target").alias("further"))
        best = cut(best.join(nxt, "target", "left").select("anchor", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        still, best = best.filter("moved").limit(1).count(), best.drop("moved")
        if not still:
            break
    return best


def assign(forms: list[tuple[str, list[str], int]], org: bool) -> list[str]:
    """The entity, within its anchor, of each form (kind, rest, count)."""
    return _assign_orgs(forms) if org else _assign_persons([(r, n) for _, r, n in forms])


def _assign_persons(forms: list[tuple[list[str], int]]) -> list[str]:
    full: Counter = Counter()
    initials: set[str] = set()
    for rest, n in forms:
        g = rest[0] if rest else ""
        if g.endswith("."):
            initials.add(g[0])
        elif g and g[0] != "?":
            full[g] += n
    # Short forms of several names: one that is there, else one whose initial is there, else the first.
    meant: dict[str, str] = {}
    for rest, n in forms:
        if rest and rest[0][0] == "?":
            options = FORMAL[rest[0][1:]]
            there = [f for f in options if f in full]
            meant[rest[0]] = max(there, key=lambda f: full[f]) if there else next((f for f in options if f[0] in initials), options[0])
    for rest, n in forms:
        if rest and rest[0] in meant:
            full[meant[rest[0]]] += n
    by_initial: dict[str, list[str]] = {}
    for f in full:
        by_initial.setdefault(f[0], []).append(f)
    middles: dict[str, Counter] = {}

    def first_name(rest: list[str]) -> str:
        if not rest:
            return max(full, key=lambda f: (full[f], f)) if len(full) == 1 else ""
        g = rest[0]
        if g in meant:
            return meant[g]
        if not g.endswith("."):
            return g
        fit = [f for f in by_initial.get(g[0], ()) if f.startswith(g[:-1])]
        if not fit and len(g) > 2:
            short = [m for s, m in FORMAL.items() if s.startswith(g[:-1]) for m in m if m in full]
            fit = short
        return max(fit, key=lambda f: (full[f], f)) if fit else g[0] + "."

    named = [first_name(rest) for rest, _ in forms]
    for (rest, n), f in zip(forms, named, strict=True):
        if len(rest) > 1:
            middles.setdefault(f, Counter())[rest[1]] += n
    out = []
    for (rest, _), f in zip(forms, named, strict=True):
        m = middles.get(f, {})
        out.append(f if len(m) < 2 else f"{f} {rest[1] if len(rest) > 1 else max(m, key=lambda x: (m[x], x))}")
    return out


def _assign_orgs(forms: list[tuple[str, list[str], int]]) -> list[str]:
    whole: Counter = Counter()
    for kind, rest, n in forms:
        whole[kind, tuple(rest)] += n

    def fits(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
        return len(a) == len(b) and all(x == y or one_edit(x, y) or (x.endswith(".") and y.startswith(x[:-1])) or (y.endswith(".") and x.startswith(y[:-1])) for x, y in zip(a, b, strict=True))

    # Commonest and unshortened forms first; a later form joins the first entity of its kind that it fits.
    leaders: list[tuple[str, tuple[str, ...]]] = []
    entity: dict[tuple[str, tuple[str, ...]], int] = {}
    for form in sorted(whole, key=lambda f: (any(t.endswith(".") for t in f[1]), -whole[f], f)):
        i = next((i for i, (kind, rest) in enumerate(leaders) if kind == form[0] and fits(form[1], rest)), None)
        if i is None:
            i = len(leaders)
            leaders.append(form)
        entity[form] = i
    return [f"#{entity[kind, tuple(rest)]}" for kind, rest, _ in forms]


def entities(creators: DataFrame, source_refs: DataFrame) -> DataFrame:
    """``(row_id, entity, size)`` of every row with a name; ``size``: rows of the entity."""
    names = typed_names(creators, source_refs)
    parsed = parse_names(names, *common_words(names)).withColumn("rest", F.array_join("rest", "\x1f"))
    rows = written(parsed.withColumn("form", F.xxhash64("org", "anchor", "kind", "rest")))
    # Everything from here on is over distinct forms, and only their numbers go back to the rows.
    forms = cut(rows.groupBy("form", "org", "anchor", "kind", "rest").agg(F.count("*").alias("n")))
    links = anchor_links(cut(forms.groupBy("anchor").agg(F.sum("n").alias("n"))))
    combos = forms.join(links, "anchor", "left").select("form", "n", "org", F.coalesce("target", "anchor").alias("home"), "kind", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple, forms: list) -> None:
            merged: dict[tuple, int] = {}
            for _, kind, rest, n in forms:
                merged[kind, rest] = merged.get((kind, rest), 0) + n
            named = assign([(kind, rest.split("\x1f") if rest else [], n) for (kind, rest), n in merged.items()], key[0])
            of = dict(zip(merged, named, strict=True))
            sizes: Counter = Counter()
            for k, n in merged.items():
                sizes[of[k]] += n
            for form, kind, rest, _ in forms:
                name = of[kind, rest]
                ids.append(form)
                names_.append(f"{key[0]}|{key[1]}|{name}")
                totals.append(sizes[name])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names_, pa.string()), pa.array(totals, pa.int64())], names=["form", "name", "size"])

        ids: list[int] = []
        names_: list[str] = []
        totals: list[int] = []
        held: list = []
        key = None
        for b in batches:
            for form, n, org, home, kind, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (org, home):
                    if held:
                        out(key, held)
                    key, held = (org, home), []
                held.append((form, kind, rest, n))
            yield batch()
            ids, names_, totals = [], [], []
        if held:
            out(key, held)
        yield batch()

    resolved = combos.repartition("org", "home").sortWithinPartitions("org", "home").mapInArrow(run, "form bigint, name string, size bigint").select("form", F.xxhash64("name").alias("entity"), "size")
    return rows.select("row_id", "form").join(resolved, "form").select("row_id", "entity", "size")


def same_entity_pairs(members: DataFrame, id_col: str = "row_id", key_col: str = "entity", size_col: str = "size") -> DataFrame:
    """``(id_a, id_b)`` of every two rows of one entity, whose number of rows is in ``size_col``.

    Up to ``BLOCK`` rows are paired in one list. A larger entity is cut into blocks of about ``BLOCK`` rows, and each
    pair of blocks is a group of its own, so that no task holds more than two blocks of one entity.
    """
    rows = members.filter(F.col(size_col) > 1).select(F.col(key_col).alias("key"), F.col(id_col).alias("id"), F.col(size_col).alias("size"))
    few = rows.filter(F.col("size") <= BLOCK).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = few.select(F.posexplode("ids").alias("i", "id_a"), "ids").select("id_a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("id_b"))
    cells = rows.filter(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    left = cells.select("key", F.col("id").alias("a"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = cells.select("key", F.col("id").alias("b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    return pairs.unionByName(left.join(right, ["key", "i", "j"]).filter("a < b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")))
