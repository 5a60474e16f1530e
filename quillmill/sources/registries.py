"""Records out of the JSON of registries: a schema, a projection, an explode. Broken JSON gives no rows.

Input: a frame with a string column ``body``; output: the record columns, plus full-text places where a registry has them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import identifiers as I
from quillmill.operators.records import reconstruct_abstract

#: Hosts that serve open copies without a session (fixed values).
OPEN_HOSTS = ("arxiv.org", "biorxiv.org", "medrxiv.org", "ncbi.nlm.nih.gov", "plos.org", "frontiersin.org", "mdpi.com", "biomedcentral.com", "elifesciences.org", "peerj.com", "zenodo.org")


def record(*, title, authors, year, venue, doi, source, source_id, arxiv_id=None, pmid=None, pmcid=None, url=None, abstract_text=None) -> list[Column]:
    """The columns of a record, in order."""
    none = F.lit(None).cast("string")
    cols = {"title": title, "authors": authors, "year": year, "venue": venue, "doi": doi, "arxiv_id": arxiv_id, "pmid": pmid, "pmcid": pmcid, "url": url, "abstract_text": abstract_text, "source": F.lit(source), "source_id": source_id}
    return [(none if c is None else c).alias(n) for n, c in cols.items()]


def year_of(c: Column) -> Column:
    """A year from 1000 to 2999 at the start of a value."""
    y = F.regexp_extract(c.cast("string"), r"^\s*([0-9]{4})", 1).try_cast("int")
    return F.when(y.between(1000, 2999), y)


def strip_tags(c: Column) -> Column:
    """Markup removed, the five XML entities decoded once, white space collapsed."""
    t = F.regexp_replace(c, r"<[^>]*>", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def requires_session(url: Column, open_license: Column) -> Column:
    """False only for an open licence or a host known to be open."""
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    known = F.exists(F.array(*map(F.lit, OPEN_HOSTS)), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    return ~(F.coalesce(known, F.lit(False)) | F.coalesce(open_license, F.lit(False)))


def _parsed(df: DataFrame, schema: str, body: str) -> DataFrame:
    return df.select(F.from_json(body, f"struct<{schema}>", {"mode": "PERMISSIVE"}).alias("j"))


def openalex(df: DataFrame, body: str = "body") -> DataFrame:
    work = "id:string,doi:string,display_name:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,primary_location:struct<source:struct<display_name:string>,landing_page_url:string>,authorships:array<struct<author:struct<display_name:string>>>,ids:struct<pmid:string,pmcid:string>,open_access:struct<oa_url:string>,locations:array<struct<pdf_url:string>>"
    j = _parsed(df, f"results:array<struct<{work}>>", body).select(F.explode("j.results").alias("w"))
    places = F.array_distinct(F.array_compact(F.concat(F.array(F.col("w.open_access.oa_url")), F.coalesce(F.transform("w.locations", lambda l: l["pdf_url"]), F.array().cast("array<string>")))))
    return j.select(
        *record(title=F.col("w.display_name"), authors=F.transform("w.authorships", lambda a: a["author"]["display_name"]), year=year_of(F.col("w.publication_year")), venue=F.col("w.primary_location.source.display_name"), doi=I.normalize_doi("w.doi"), source="openalex", source_id=F.col("w.id"), pmid=I.normalize_pmid(F.regexp_extract("w.ids.pmid", r"([0-9]+)/?$", 1)), pmcid=I.normalize_pmcid(F.regexp_extract("w.ids.pmcid", r"([0-9]+)/?$", 1)), url=F.col("w.primary_location.landing_page_url"), abstract_text=reconstruct_abstract(F.col("w.abstract_inverted_index"))),
        F.transform(places, lambda u: F.struct(u.alias("url"), requires_session(u, F.lit(None).cast("boolean")).alias("requires_session"))).alias("candidates"),
    )


def crossref(df: DataFrame, body: str = "body") -> DataFrame:
    item = "DOI:string,title:array<string>,author:array<struct<given:string,family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,URL:string,abstract:string,license:array<struct<URL:string,`delay-in-days`:int>>,link:array<struct<URL:string,`content-type`:string>>"
    j = _parsed(df, f"message:struct<items:array<struct<{item}>>>", body).select(F.explode("j.message.items").alias("w"))
    name = lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"])
    open_ = F.exists(F.coalesce("w.license", F.array()), lambda l: F.lower(l["URL"]).contains("creativecommons.org/") & (F.coalesce(l["delay-in-days"], F.lit(0)) <= 0))
    links = F.array_distinct(F.transform(F.filter(F.coalesce("w.link", F.array()), lambda l: (l["content-type"] == "application/pdf") | F.lower(l["URL"]).rlike(r"\.pdf$")), lambda l: l["URL"]))
    return j.select(
        *record(title=strip_tags(F.get("w.title", F.lit(0))), authors=F.transform("w.author", name), year=year_of(F.get(F.get("w.issued.date-parts", F.lit(0)), F.lit(0))), venue=F.get("w.container-title", F.lit(0)), doi=I.normalize_doi("w.DOI"), source="crossref", source_id=F.col("w.DOI"), url=F.col("w.URL"), abstract_text=strip_tags(F.col("w.abstract"))),
        F.transform(links, lambda u: F.struct(u.alias("url"), requires_session(u, open_).alias("requires_session"))).alias("candidates"),
    )


def semantic_scholar(df: DataFrame, body: str = "body") -> DataFrame:
    item = "paperId:string,title:string,year:int,venue:string,abstract:string,url:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string,ArXiv:string,PubMed:string,PubMedCentral:string>"
    j = _parsed(df, f"data:array<struct<{item}>>", body).select(F.explode("j.data").alias("w"))
    return j.select(*record(title=F.col("w.title"), authors=F.transform("w.authors", lambda a: a["name"]), year=year_of(F.col("w.year")), venue=F.col("w.venue"), doi=I.normalize_doi("w.externalIds.DOI"), source="semanticscholar", source_id=F.col("w.paperId"), arxiv_id=I.normalize_arxiv("w.externalIds.ArXiv"), pmid=I.normalize_pmid("w.externalIds.PubMed"), pmcid=I.normalize_pmcid("w.externalIds.PubMedCentral"), url=F.col("w.url"), abstract_text=F.col("w.abstract")))


def europe_pmc(df: DataFrame, body: str = "body") -> DataFrame:
    item = "id:string,pmid:string,pmcid:string,doi:string,title:string,authorString:string,journalTitle:string,pubYear:string,abstractText:string"
    j = _parsed(df, f"resultList:struct<result:array<struct<{item}>>>", body).select(F.explode("j.resultList.result").alias("w"))
    return j.select(*record(title=F.regexp_replace(strip_tags(F.col("w.title")), r"\.$", ""), authors=F.transform(F.split(F.regexp_replace("w.authorString", r"\.$", ""), r",\s*"), lambda t: F.trim(t)), year=year_of(F.col("w.pubYear")), venue=F.col("w.journalTitle"), doi=I.normalize_doi("w.doi"), source="pmc", source_id=F.col("w.id"), pmid=I.normalize_pmid("w.pmid"), pmcid=I.normalize_pmcid("w.pmcid"), abstract_text=strip_tags(F.col("w.abstractText"))))


def pubmed_summary(df: DataFrame, body: str = "body") -> DataFrame:
    """Summaries keyed by id, in the order of the id list."""
    item = "uid:string,title:string,pubdate:string,fulljournalname:string,authors:array<struct<name:string>>,articleids:array<struct<idtype:string,value:string>>"
    j = df.select(F.from_json(F.get_json_object(body, "$.result.uids"), "array<string>").alias("ids"), F.from_json(F.get_json_object(body, "$.result"), "map<string,string>").alias("m"))
    w = j.select(F.posexplode("ids").alias("pos", "id"), "m").select("pos", "id", F.from_json(F.try_element_at("m", F.col("id")), f"struct<{item}>").alias("w")).filter("w.uid IS NOT NULL")
    of = lambda kind: F.get(F.transform(F.filter(F.coalesce("w.articleids", F.array()), lambda a: a["idtype"] == kind), lambda a: a["value"]), F.lit(0))
    return w.select(*record(title=F.regexp_replace(strip_tags(F.col("w.title")), r"\.$", ""), authors=F.transform("w.authors", lambda a: a["name"]), year=year_of(F.col("w.pubdate")), venue=F.col("w.fulljournalname"), doi=I.normalize_doi(of("doi")), source="pmc", source_id=F.col("id"), pmid=I.normalize_pmid(F.col("id")), pmcid=I.normalize_pmcid(of("pmc"))))


def search_ids(df: DataFrame, body: str = "body") -> DataFrame:
    """Ids of a search answer."""
    return df.select(F.explode(F.from_json(F.get_json_object(body, "$.esearchresult.idlist"), "array<string>")).alias("id"))


def unpaywall(df: DataFrame, body: str = "body") -> DataFrame:
    """``(doi, url, is_best)`` of open copies, PDFs before landing pages."""
    place = "struct<url:string,url_for_pdf:string>"
    j = _parsed(df, f"doi:string,best_oa_location:{place},oa_locations:array<{place}>", body)
    url = lambda l: F.coalesce(l["url_for_pdf"], l["url"])
    urls = F.array_distinct(F.array_compact(F.concat(F.array(url(F.col("j.best_oa_location"))), F.transform(F.coalesce("j.oa_locations", F.array()), url))))
    return j.select(I.normalize_doi("j.doi").alias("doi"), F.posexplode(urls).alias("pos", "url")).select("doi", "url", (F.col("pos") == 0).alias("is_best"))


def library_items(df: DataFrame, body: str = "body") -> DataFrame:
    """``(key, version, fields, creators)`` of a page of library items."""
    j = df.select(F.explode(F.from_json(body, "array<struct<key:string,version:int,data:string>>")).alias("i"))
    return j.select("i.key", "i.version", F.from_json("i.data", "map<string,string>").alias("fields"), F.from_json(F.get_json_object("i.data", "$.creators"), "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>").alias("creators"))


def extra_fields(extra: Column) -> Column:
    """``Key: value`` lines of a notes field as a map, the first of a key."""
    pairs = F.filter(F.transform(F.split(extra, "\n"), lambda l: F.struct(F.lower(F.trim(F.substring_index(l, ":", 1))).alias("key"), F.trim(F.regexp_replace(l, r"^[^:]*:", "")).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    with_colon = F.filter(pairs, lambda p: extra.contains(":"))
    first = F.filter(with_colon, lambda p, i: ~F.exists(F.slice(with_colon, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(first)


def item_record(items: DataFrame) -> DataFrame:
    """Records of library items; identifiers also from the notes field."""
    f = lambda k: F.nullif(F.try_element_at("fields", F.lit(k)), F.lit(""))
    extra = extra_fields(F.coalesce(F.try_element_at("fields", F.lit("extra")), F.lit("")))
    e = lambda k: F.try_element_at(extra, F.lit(k))
    name = lambda c: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", c["firstName"], c["lastName"])), F.lit("")), c["name"])
    return items.select(*record(title=f("title"), authors=F.transform(F.filter(F.coalesce("creators", F.array()), lambda c: c["creatorType"] == "author"), name), year=I.year_from_date(f("date")), venue=F.coalesce(f("publicationTitle"), f("proceedingsTitle"), f("bookTitle")), doi=I.normalize_doi(F.coalesce(f("DOI"), e("doi"))), source="library", source_id=F.col("key"), arxiv_id=I.normalize_arxiv(F.coalesce(e("arxiv"), e("arxiv id"))), pmid=I.normalize_pmid(e("pmid")), pmcid=I.normalize_pmcid(e("pmcid")), url=f("url"), abstract_text=f("abstractNote")))
