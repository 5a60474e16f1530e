"""Quality of extraction: one-to-one matching with truth, alignment of texts, rates over a corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as X
from quillmill.session import batch_udf

#: Least title Jaccard, score of a match by author and venue, by author and year, least text Jaccard (as a fraction).
TITLE_JACCARD, AUTHOR_VENUE, AUTHOR_YEAR, TEXT_NUM, TEXT_DEN = 0.8, 0.9, 0.75, 3, 5


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence by bit-parallel rows: one big-integer step for each element of b."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alignment(a: list, b: list) -> float:
    """2 LCS / (n + m); 1 for two empty lists, 0 if just one is empty."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2 * lcs_length(a, b) / (len(a) + len(b))


@batch_udf("double")
def word_alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    """Alignment of two word arrays; null counts as empty."""
    return pd.Series([alignment(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b, strict=True)])


@batch_udf("int")
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two word arrays, row by row in vector steps."""

    def one(x, y) -> int:
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        ids: dict = {}
        p, q = (np.array([ids.setdefault(w, len(ids)) for w in z], np.int64) for z in (x, y))
        row = np.arange(len(q) + 1)
        for i, w in enumerate(p):
            change = row[:-1] + (q != w)
            best = np.minimum(change, row[1:] + 1)
            # Insertions: a running minimum of value less position.
            best = np.concatenate([[i + 1], best])
            row = np.minimum.accumulate(best - np.arange(len(best))) + np.arange(len(best))
        return int(row[-1])

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits over reference words; null for a reference without words."""
    r, h = X.words(reference), X.words(hypothesis)
    return F.when(F.size(r) > 0, word_edits(r, h) / F.size(r))


def percentile_nearest(c: Column | str, p: float) -> Column:
    """Nearest rank: the ceil(p n)-th value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def percentile_rounded(values: Column, p: float) -> Column:
    """Of a sorted array, the element at the rounded share of the last index."""
    return F.element_at(values, (F.round((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def exact_pass(truth: DataFrame, extracted: DataFrame, key: str, doc: str = "doc", method: str = "exact", score: float = 1.0) -> DataFrame:
    """One-to-one pairs of equal keys within a document: the n-th of a key on either side. Null keys match nothing."""
    rank = lambda d, i: d.filter(F.col(key).isNotNull()).select(doc, key, i, F.row_number().over(Window.partitionBy(doc, key).orderBy(i)).alias("nth"))
    return rank(truth, "t_idx").join(rank(extracted, "e_idx"), [doc, key, "nth"]).select(doc, "t_idx", "e_idx", F.lit(method).alias("method"), F.lit(score).alias("score"))


def greedy_match(truth: list[dict], extracted: list[dict]) -> list[tuple[int, int, str, float]]:
    """Matches of one document, best evidence first; each side is used once, ties go to the lower index.

    Entries: doi, arxiv, title, year, author (surname key), venue, text; all may be None.
    """
    free_t, free_e = set(range(len(truth))), set(range(len(extracted)))
    out: list[tuple[int, int, str, float]] = []

    def take(t: int, e: int, method: str, score: float) -> None:
        free_t.discard(t)
        free_e.discard(e)
        out.append((t, e, method, score))

    def equal(field, method: str, score: float, allowed=lambda t, e: True) -> None:
        by: dict = {}
        for e in sorted(free_e):
            if (k := field(extracted[e])) is not None:
                by.setdefault(k, []).append(e)
        for t in sorted(free_t):
            k = field(truth[t])
            e = next((e for e in by.get(k, ()) if e in free_e and allowed(truth[t], extracted[e])), None) if k is not None else None
            if e is not None:
                take(t, e, method, score)

    def title(x: dict):
        return x.get("title") or None

    def same_year(t: dict, e: dict) -> bool:
        return t.get("year") is not None and t.get("year") == e.get("year")

    def digits(x: dict) -> set[str]:
        return set(__import__("re").findall(r"\d+", x.get("title") or ""))

    def conflict(t: dict, e: dict) -> bool:
        return bool(digits(t) - digits(e)) and bool(digits(e) - digits(t))

    def fuzzy(field: str, method: str, num: int, den: int, guard: bool) -> None:
        sets_t = {t: set((truth[t].get(field) or "").split()) for t in free_t}
        holders: dict[str, list[int]] = {}
        sets_e = {e: set((extracted[e].get(field) or "").split()) for e in free_e}
        for e in sorted(sets_e):
            for w in sets_e[e]:
                holders.setdefault(w, []).append(e)
        for t in sorted(sets_t):
            best = None
            for e in {e for w in sets_t[t] for e in holders.get(w, ()) if e in free_e}:
                both, all_ = len(sets_t[t] & sets_e[e]), len(sets_t[t] | sets_e[e])
                if both * den >= all_ * num and not (guard and conflict(truth[t], extracted[e])):
                    rank = (-both / all_, e)
                    best = min(best, rank) if best else rank
            if best:
                take(t, best[1], method, -best[0])

    equal(lambda x: x.get("doi"), "doi", 1.0)
    equal(lambda x: x.get("arxiv"), "arxiv", 1.0)
    equal(title, "title", 1.0, same_year)
    equal(title, "title", 1.0)
    fuzzy("title", "title_jaccard", 4, 5, True)
    equal(lambda x: (x["author"], x["year"], x["venue"]) if x.get("author") and x.get("year") and x.get("venue") else None, "author_venue", AUTHOR_VENUE, lambda t, e: not (title(t) and title(e)))
    equal(lambda x: (x["author"], x["year"]) if x.get("author") and x.get("year") else None, "author_year", AUTHOR_YEAR, lambda t, e: not conflict(t, e))
    fuzzy("text", "text_jaccard", TEXT_NUM, TEXT_DEN, False)
    return sorted(out)


def match_references(truth: DataFrame, extracted: DataFrame, doc: str = "doc") -> DataFrame:
    """Greedy matches of every document; one document's references are one bounded group.

    Both sides: (doc, idx, doi, arxiv, title, year, author, venue, text).
    """
    fields = ("doi", "arxiv", "title", "year", "author", "venue", "text")
    kind = dict(truth.dtypes)[doc]

    def run(key, t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        def rows(d: pd.DataFrame) -> list[dict]:
            d = d.sort_values("idx")
            return [{f: (None if v is None or v != v else v) for f, v in zip(("idx", *fields), r, strict=True)} for r in d[["idx", *fields]].itertuples(index=False, name=None)]

        a, b = rows(t), rows(e)
        got = greedy_match(a, b)
        return pd.DataFrame([(key[0], int(a[i]["idx"]), int(b[j]["idx"]), m, float(s)) for i, j, m, s in got], columns=[doc, "t_idx", "e_idx", "method", "score"])

    return truth.groupBy(doc).cogroup(extracted.groupBy(doc)).applyInPandas(run, f"{doc} {kind}, t_idx int, e_idx int, method string, score double")


def summarize(papers: DataFrame) -> DataFrame:
    """One row of rates as sums of counts, 0 for an empty denominator: (truth, extracted, matched) of each paper."""
    t, e, m = (F.sum(c) for c in ("truth", "extracted", "matched"))
    return papers.agg(F.count("*").alias("papers"), t.alias("truth"), e.alias("extracted"), m.alias("matched"), X.ratio(m, t).alias("recall"), X.ratio(m, e).alias("precision"), F.avg((F.col("truth") == F.col("extracted")).cast("double")).alias("count_exact"))


def person_key(name: Column) -> Column:
    """``surname|initial`` of a printed name, in plain lower case; null without letters."""
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    comma = t.contains(",")
    last = F.when(comma, F.trim(F.substring_index(t, ",", 1))).otherwise(F.element_at(F.split(t, " "), -1))
    first = F.when(comma, F.trim(F.substring_index(t, ",", -1))).otherwise(F.element_at(F.split(t, " "), 1))
    return F.when(t.rlike(r"\p{L}"), F.concat(F.lower(F.regexp_replace(last, r"[^\p{L}-]", "")), F.lit("|"), F.lower(F.substring(F.regexp_replace(first, r"[^\p{L}]", ""), 1, 1))))


def author_matches(truth: Column, extracted: Column) -> Column:
    """Size of the multiset intersection of two author lists' keys."""
    numbered = lambda xs: F.transform(xs, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(xs, F.lit(1), i), lambda y: y == x)).cast("string")))
    keys = lambda names: F.filter(F.transform(names, lambda n: person_key(n)), lambda k: k.isNotNull())
    return F.size(F.array_intersect(numbered(keys(truth)), numbered(keys(extracted))))


def title_equal(a: Column, b: Column) -> Column:
    """Equal normal forms; two unknown titles are equal, one is not."""
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(X.normalize_title(a) == X.normalize_title(b), F.lit(False)))


def paper_title_matches(truth: Column, extracted: Column) -> Column:
    """Equal, or nine tenths of the words shared."""
    return title_equal(truth, extracted) | F.coalesce(X.jaccard(X.word_set(truth), X.word_set(extracted)) >= 0.9, F.lit(False))


def doi_is_printed(doi: Column, squashed: Column) -> Column:
    """The DOI stands in a text without white space."""
    return squashed.contains(F.lower(doi))


def marker_correctness(markers: DataFrame, matches: DataFrame, cited: DataFrame, doc: str = "doc") -> DataFrame:
    """``(doc, targets, correct, keys_hit, keys_cited)``, by key and not by occurrence.

    ``markers``: (doc, targets); ``matches``: (doc, e_idx, key); ``cited``: (doc, key).
    """
    t = markers.select(doc, F.explode("targets").alias("e_idx")).distinct()
    keyed = t.join(matches.select(doc, "e_idx", "key"), [doc, "e_idx"], "left")
    wanted = cited.select(doc, "key").distinct().withColumn("cited", F.lit(1))
    a = keyed.join(wanted, [doc, "key"], "left").groupBy(doc).agg(F.count_distinct("e_idx").alias("targets"), F.count_distinct(F.when(F.col("cited") == 1, F.col("e_idx"))).alias("correct"), F.count_distinct(F.when(F.col("cited") == 1, F.col("key"))).alias("keys_hit"))
    return wanted.groupBy(doc).agg(F.count("*").alias("keys_cited")).join(a, doc, "full").select(doc, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("targets", "correct", "keys_hit", "keys_cited")))


def duplicate_groups(truth: DataFrame, doc: str = "doc", key: str = "title", identifier: str = "doi") -> DataFrame:
    """``(doc, key, n)``: entries of one title that at most one identifier tells apart."""
    return truth.filter(F.col(key).isNotNull()).groupBy(doc, key).agg(F.count("*").alias("n"), F.count_distinct(identifier).alias("ids")).filter("n >= 2 AND ids <= 1").drop("ids")


def body_lines(lines: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """Lines without captions and mathematics: what word alignment compares. ``lines``: with text and, if known, role."""
    role = F.col("role") if "role" in lines.columns else F.lit("body")
    other = role.isin("caption", "figure", "table", "algorithm", "math", "furniture", "toc") | X.caption_kind("text").isNotNull() | X.is_math_heavy("text")
    return lines.filter(~F.coalesce(other, F.lit(True)))


def body_alignment(a: DataFrame, b: DataFrame, doc: str = "doc_hash") -> DataFrame:
    """``(doc, score)``: word alignment of two texts of each document; one without the other scores 0."""
    x = a.select(doc, X.alignment_words("text").alias("wa")).join(b.select(doc, X.alignment_words("text").alias("wb")), doc, "full")
    return x.select(doc, word_alignment(F.col("wa"), F.col("wb")).alias("score"))


def percentile_by_rank(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """``(group, value)``: of each group's values in order, the one at the rounded share ``p`` of the last index. Nulls are left out.

    Rows are sorted by range, so a group of any size is spread over many tasks; the counts of each range tell which of
    them holds the wanted rank, and only that range is ranked.
    """
    from quillmill.session import cut, partitions

    x = rows.select(F.col(group).alias("g"), F.col(value).alias("v")).filter("v IS NOT NULL")
    ranged = cut(x.repartitionByRange(partitions(rows.sparkSession), "g", "v").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g")
    held = counts.withColumn("before", F.sum("n").over(w.orderBy("part")) - F.col("n")).withColumn("at", F.round((F.sum("n").over(w) - 1) * F.lit(p)).cast("bigint"))
    held = held.filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select("g", "part", (F.col("at") - F.col("before")).alias("local"))
    ranked = ranged.join(held, ["g", "part"]).withColumn("i", F.row_number().over(Window.partitionBy("g", "part").orderBy("v")) - 1)
    return ranked.filter("i = local").select(F.col("g").alias(group), F.col("v").alias(value.rsplit(".", 1)[-1]))


def order_duplicates(matches: DataFrame, groups: DataFrame, doc: str = "doc") -> DataFrame:
    """Matches in which the entries of a duplicate group are given out in order: the n-th truth entry gets the n-th match.

    ``matches``: (doc, t_idx, e_idx, ...); ``groups``: (doc, t_idx, g). Matches outside groups stay as they are.
    """
    x = matches.join(groups, [doc, "t_idx"], "left")
    by = lambda c: F.row_number().over(Window.partitionBy(doc, "g").orderBy(c))
    grouped = x.filter("g IS NOT NULL")
    truth = grouped.select(doc, "g", "t_idx", by("t_idx").alias("n"))
    ordered = grouped.drop("t_idx").withColumn("n", by("e_idx")).join(truth, [doc, "g", "n"])
    return ordered.select(*matches.columns).unionByName(x.filter("g IS NULL").select(*matches.columns))
