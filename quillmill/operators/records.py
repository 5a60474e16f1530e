"""Bibliographic records: keys, components of records of one work, merged fields, full-text places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.functions.text import normalize_title
from quillmill.session import cut

#: Sources from the most to the least trusted (fixed values).
SOURCES = ("crossref", "openalex", "semanticscholar", "pmc")
MERGED = ("title", "authors", "year", "venue", "doi", "arxiv_id", "pmid", "pmcid", "url", "abstract_text")


def source_rank(source: Column) -> Column:
    out = F.lit(len(SOURCES))
    for i, s in reversed(list(enumerate(SOURCES))):
        out = F.when(F.lower(source) == s, i).otherwise(out)
    return out


def match_keys(doi: Column, arxiv: Column, title: Column, year: Column) -> Column:
    """Blocking keys of a record; a title counts only with a year."""
    t = normalize_title(title)
    return F.array_compact(F.array(F.concat(F.lit("doi:"), I.normalize_doi(doi)), F.concat(F.lit("arxiv:"), I.normalize_arxiv(arxiv)), F.when(t != "", F.concat(F.lit("title:"), t, F.lit("|"), year.cast("string")))))


def components(edges: DataFrame, node: str, key: str) -> DataFrame:
    """``(node, component)`` from (node, key): the least node of all that are connected through shared keys.

    Each key's nodes are linked to the least of them, so a key held by a third of all nodes gives a star, not all
    pairs. Rounds of large-star and small-star joins halve the paths; lineage is cut after each. Nothing but one
    count a round reaches the driver.
    """
    least = edges.groupBy(key).agg(F.min(node).alias("r"))
    links = cut(edges.join(least, key).select(F.col(node).alias("a"), F.col("r").alias("b")).distinct())
    while True:
        both = links.filter("a <> b").unionByName(links.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: neighbours that are larger go to the least of the neighbourhood.
        m = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(m, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself go to the least of them.
        down = large.filter("b < a")
        n = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(n, "a").select(F.col("b").alias("x"), "m").unionByName(n.select(F.col("a").alias("x"), "m")).filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        fresh = cut(small)
        changed = fresh.exceptAll(links.filter("a <> b")).limit(1).count() + links.filter("a <> b").exceptAll(fresh).limit(1).count()
        links = fresh
        if not changed:
            break
    nodes = edges.select(F.col(node).alias("a")).distinct()
    return nodes.join(links, "a", "left").select(F.col("a").alias(node), F.coalesce("b", "a").alias("component"))


def merge_records(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """One row a work: each field from the most trusted record that has it, equal ranks by record id.

    Records without any key stay alone. ``members`` counts the records merged.
    """
    ranked = records.withColumn("rank", source_rank(F.col("source")))
    edges = ranked.select(key, F.explode(match_keys(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("year"))).alias("k"))
    comp = components(edges, key, "k")
    x = ranked.join(comp, key, "left").withColumn("component", F.coalesce("component", F.col(key)))
    order = F.struct("rank", key)
    present = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") if c != "authors" else F.size(F.coalesce(F.col(c), F.array())) > 0
    fields = [F.min_by(F.when(present(c), F.col(c)), F.when(present(c), order)).alias(c) for c in MERGED if c in records.columns]
    return x.groupBy("component").agg(F.min_by("source", order).alias("source"), *fields, F.count("*").alias("members"))


def static_candidates(doi: Column, arxiv: Column, pmcid: Column, resolver: str | None = None) -> Column:
    """array<struct(url, source)> of full-text addresses that follow from identifiers."""
    places = [F.when(arxiv.isNotNull(), F.struct(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv).alias("url"), F.lit("arxiv").alias("source"))), F.when(pmcid.isNotNull(), F.struct(F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), pmcid, F.lit("/pdf/")).alias("url"), F.lit("pmc").alias("source")))]
    if resolver:
        places.append(F.when(doi.isNotNull(), F.struct(F.concat(F.lit(resolver), F.lit("?id=doi:"), doi).alias("url"), F.lit("resolver").alias("source"))))
    return F.array_compact(F.array(*places))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def reconstruct_abstract(index: Column) -> Column:
    """Text of a map word -> positions; of two words at one position the later in word order stays."""
    pairs = F.flatten(F.transform(F.array_sort(F.map_entries(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = F.array_sort(pairs)
    kept = F.filter(last, lambda x, i: F.coalesce(F.get(last, i + 1)["p"] != x["p"], F.lit(True)))
    return F.nullif(F.array_join(F.transform(kept, lambda x: x["w"]), " "), F.lit(""))
