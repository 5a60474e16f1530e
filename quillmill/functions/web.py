"""Addresses, HTML and headers: row-local parsing in Arrow batches, everything else in Catalyst.

Malformed input gives null (or an empty array), never an error.
"""

from __future__ import annotations

import html as html_entities
import re
from html.parser import HTMLParser
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import col
from quillmill.session import batch_udf

#: Query parameters that only track visits (fixed values).
TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader gclid dclid fbclid msclkid mc_cid mc_eid igshid yclid twclid _hsenc _hsmi vero_id wickedid ref_src spm".split())
DEFAULT_PORTS = {"http": 80, "https": 443}
#: Suffixes of more than one label (fixed values; the full list may be passed instead).
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au edu.au org.au gov.au co.jp ac.jp or.jp co.nz ac.nz com.br edu.br org.br com.cn edu.cn org.cn co.in ac.in co.kr ac.kr co.za ac.za com.tr edu.tr com.mx edu.tw com.tw edu.sg com.sg edu.hk".split())


def parse_url(raw: str | None) -> dict | None:
    """Scheme, host, port, path and query of an http address, tracking parameters, fragment and credentials dropped."""
    if not raw:
        return None
    try:
        u = urlsplit(raw.strip())
        port = u.port
    except ValueError:
        return None
    scheme, host = u.scheme.lower(), (u.hostname or "").rstrip(".").lower()
    if scheme not in DEFAULT_PORTS or not host or re.search(r"[^\w.:\-\[\]]", host):
        return None
    query = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in TRACKING]
    path = quote(unquote_to_bytes(u.path or "/"), safe="/:@!$&'()*+,;=~-._%")
    segments: list[str] = []
    for s in path.split("/")[1:]:
        if s == "..":
            segments = segments[:-1]
        elif s != ".":
            segments.append(s)
    return {"scheme": scheme, "host": host, "port": None if port == DEFAULT_PORTS[scheme] else port, "path": "/" + "/".join(segments), "query": query}


def normalize_url_text(raw: str | None) -> str | None:
    p = parse_url(raw)
    if p is None:
        return None
    query = "&".join(f"{quote(k, safe='')}={quote(v, safe='')}" for k, v in p["query"])
    return f"{p['scheme']}://{p['host']}{f':{p["port"]}' if p['port'] else ''}{p['path']}{'?' + query if query else ''}"


@batch_udf("string")
def normalize_url(raw: pd.Series) -> pd.Series:
    """Canonical form of an address."""
    return raw.map(normalize_url_text, na_action="ignore")


@batch_udf("string")
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """A reference made absolute against a base, in canonical form."""

    def one(b, h):
        if not b or h is None:
            return None
        try:
            return normalize_url_text(urljoin(b, h.strip()))
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)])


@batch_udf("string")
def percent_decode(text: pd.Series) -> pd.Series:
    """Percent escapes decoded; a plus stays a plus; bad bytes become U+FFFD."""
    return text.map(lambda t: unquote_to_bytes(t).decode("utf-8", "replace"), na_action="ignore")


def percent_encode(c: Column | str) -> Column:
    """Percent escapes, a space as %20."""
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def with_query(base: Column, pairs: list[tuple[str, Column]]) -> Column:
    """An address with encoded parameters; null values are left out."""
    parts = F.array_compact(F.array(*[F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), percent_encode(v))) for k, v in pairs]))
    return F.when(F.size(parts) == 0, base).otherwise(F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.array_join(parts, "&")))


def build_openurl(base: Column, title: Column, author: Column, year: Column, doi: Column, venue: Column) -> Column:
    """An OpenURL 1.0 query for an article."""
    return with_query(base, [("url_ver", F.lit("Z39.88-2004")), ("rft_val_fmt", F.lit("info:ofi/fmt:kev:mtx:journal")), ("rft.atitle", title), ("rft.au", author), ("rft.date", year.cast("string")), ("rft_id", F.when(doi.isNotNull(), F.concat(F.lit("info:doi/"), doi))), ("rft.jtitle", venue)])


def host_in_domain(host: Column, domain: Column) -> Column:
    """The host is the domain or below it."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def public_suffix(host: Column, suffixes: frozenset[str] = SUFFIXES) -> Column:
    """The longest known suffix of several labels, else the last label."""
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when((F.size(labels) >= 2) & two.isin(sorted(suffixes)), two).otherwise(F.element_at(labels, -1))


def registrable_domain(host: Column) -> Column:
    """The label above the public suffix, with the suffix."""
    n = F.size(F.split(public_suffix(host), r"\.")) + 1
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))


def host_decision(host: Column, deny: list[str], allow: list[str]) -> Column:
    """block if a denied domain holds the host, else allow if an allowed one does, else block."""
    held = lambda domains: F.exists(F.array(*map(F.lit, domains)), lambda d: host_in_domain(host, d)) if domains else F.lit(False)
    return F.when(held(deny), "block").when(held(allow), "allow").otherwise("block")


def mime_type(c: Column | str) -> Column:
    return F.lower(F.trim(F.substring_index(col(c), ";", 1)))


def content_disposition(c: Column | str) -> Column:
    """struct(kind, filename) of a header."""
    h = col(c)
    name = F.coalesce(F.nullif(F.regexp_extract(h, r"(?i)filename\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.nullif(F.regexp_extract(h, r"(?i)filename\s*=\s*([^;\s\"]+)", 1), F.lit("")))
    return F.struct(F.lower(F.trim(F.substring_index(h, ";", 1))).alias("kind"), name.alias("filename"))


def link_header(c: Column | str) -> Column:
    """array<struct(url, rel)> of an RFC 8288 header."""
    parts = F.regexp_extract_all(col(c), F.lit(r"<[^>]*>[^<]*"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"<([^>]*)>", 1).alias("url"), F.regexp_extract(p, r"(?i)rel\s*=\s*\"?([^\";,]+)", 1).alias("rel")))


def netscape_cookie(c: Column | str) -> Column:
    """struct of a tab-separated cookie line; null if it has not seven fields or is a comment."""
    line = F.regexp_replace(col(c), r"^#HttpOnly_", "")
    f = F.split(line, "\t")
    at = lambda i: F.get(f, i)
    return F.when((F.size(f) == 7) & ~F.startswith(line, F.lit("#")) & at(4).rlike("^[0-9]+$"), F.struct(F.regexp_replace(at(0), r"^\.", "").alias("domain"), (F.upper(at(1)) == "TRUE").alias("subdomains"), at(2).alias("path"), (F.upper(at(3)) == "TRUE").alias("secure"), at(4).cast("bigint").alias("expires"), at(5).alias("name"), at(6).alias("value")))


def cookie_matches(cookie: Column, host: Column, path: Column, secure: Column) -> Column:
    """The cookie goes with a request."""
    d = cookie["domain"]
    fits = (host == d) | (cookie["subdomains"] & host_in_domain(host, d))
    below = (path == cookie["path"]) | F.startswith(path, F.when(F.endswith(cookie["path"], F.lit("/")), cookie["path"]).otherwise(F.concat(cookie["path"], F.lit("/"))))
    return fits & below & (secure | ~cookie["secure"])


def classify_pdf_url(url: Column) -> Column:
    """struct(verdict, reasons): likely, possible or no PDF, by the address alone."""
    path, query = F.lower(F.parse_url(url, F.lit("PATH"))), F.lower(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")))
    likely = [(path.rlike(r"\.pdf$"), "extension"), (path.rlike(r"/pdf(?:/|$)|/pdfdirect/|/epdf/"), "path segment"), (path.rlike(r"^/pdf/[0-9]{4}\.[0-9]+"), "preprint")]
    possible = [(query.rlike(r"(?:^|&)(?:type|format|download|mime)=[^&]*pdf"), "parameter"), (path.contains("fulltext") | path.contains("download"), "download path")]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in likely + possible]))
    any_of = lambda cs: F.greatest(*[F.coalesce(c, F.lit(False)).cast("int") for c, _ in cs]) == 1
    return F.struct(F.when(any_of(likely), "likely").when(any_of(possible), "possible").otherwise("no").alias("verdict"), reasons.alias("reasons"))


def classify_pdf_response(url: Column, content_type: Column, disposition: Column) -> Column:
    """Verdict from the headers first, from the address if they say nothing."""
    mime, name = mime_type(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(content_disposition(disposition)["filename"], F.lit("")))
    return F.when(mime.isin("application/pdf", "application/x-pdf"), "likely").when(F.endswith(name, F.lit(".pdf")), "likely").when(mime.isin("", "application/octet-stream", "binary/octet-stream"), classify_pdf_url(url)["verdict"]).otherwise("no")


class _Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str]]] = []
        self.text: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in reversed(attrs)}))
        self.hidden += tag in ("script", "style")
        self.text.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, {k: v or "" for k, v in reversed(attrs)}))
        self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1
        self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def scan_html(html: str | None) -> _Tags:
    """Opening tags with attributes and the visible text of a page."""
    p = _Tags()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass
    return p


@batch_udf("array<struct<name:string,attrs:map<string,string>>>")
def html_tags(html: pd.Series) -> pd.Series:
    """Opening tags of a page in order."""
    return html.map(lambda h: [{"name": n, "attrs": a} for n, a in scan_html(h).tags])


@batch_udf("string")
def html_text(html: pd.Series) -> pd.Series:
    """Visible text, white space collapsed."""
    return html.map(lambda h: " ".join("".join(scan_html(h).text).split()), na_action="ignore")


@batch_udf("string")
def decode_entities(text: pd.Series) -> pd.Series:
    """Named and numeric entities decoded once."""
    return text.map(html_entities.unescape, na_action="ignore")


def attribute_values(tags: Column, tag: str, attribute: str) -> Column:
    """Values of one attribute of one element."""
    found = F.filter(tags, lambda t: (t["name"] == tag) & F.map_contains_key(t["attrs"], attribute))
    return F.transform(found, lambda t: t["attrs"][attribute])


def meta_content(tags: Column, name: str) -> Column:
    """Contents of the meta elements of a name or property."""
    found = F.filter(tags, lambda t: (t["name"] == "meta") & (F.lower(F.coalesce(F.try_element_at(t["attrs"], F.lit("name")), F.try_element_at(t["attrs"], F.lit("property")))) == name.lower()) & F.map_contains_key(t["attrs"], "content"))
    return F.transform(found, lambda t: t["attrs"]["content"])


#: Names of meta elements that declare a DOI, most trusted first (fixed values).
DOI_METAS = ("citation_doi", "bepress_citation_doi", "prism.doi", "dc.identifier.doi", "dc.identifier")


def declared_dois(tags: Column) -> Column:
    """DOIs that a page declares, most trusted first."""
    from quillmill.functions.identifiers import normalize_doi

    found = F.flatten(F.array(*[meta_content(tags, n) for n in DOI_METAS]))
    return F.array_distinct(F.filter(F.transform(found, lambda v: normalize_doi(v)), lambda v: v.isNotNull()))


@batch_udf("array<struct<url:string,verdict:string,source:string>>")
def pdf_links(html: pd.Series, base: pd.Series) -> pd.Series:
    """PDF links of a page: citation meta, typed links, anchors; each address once."""

    def one(h, b):
        out: dict[str, dict] = {}
        tags = scan_html(h).tags
        found = [(a.get("content"), "meta") for n, a in tags if n == "meta" and a.get("name", "").lower() == "citation_pdf_url"]
        found += [(a.get("href"), "link") for n, a in tags if n == "link" and a.get("type", "").lower() == "application/pdf"]
        found += [(a.get("href"), "anchor") for n, a in tags if n == "a"]
        for href, source in found:
            try:
                url = normalize_url_text(urljoin(b or "", (href or "").strip()))
            except ValueError:
                url = None
            if not url or url in out:
                continue
            path = urlsplit(url).path.lower()
            likely = source != "anchor" or path.endswith(".pdf") or re.search(r"/pdf(?:/|$)", path)
            if likely or "download" in path or "fulltext" in path:
                out[url] = {"url": url, "verdict": "likely" if likely else "possible", "source": source}
        return list(out.values())

    return pd.Series([one(h, b) for h, b in zip(html, base, strict=True)])


def inspect_page(url: Column, html: Column) -> Column:
    """struct(primary_doi, dois, arxiv_ids, pdfs) of a page: declared DOIs first, then those of its address and text."""
    from quillmill.functions.identifiers import all_dois, arxiv_ids_in_text, dois_in_url

    tags, text = html_tags(html), html_text(html)
    declared, in_url = declared_dois(tags), dois_in_url(url)
    dois = F.array_distinct(F.concat(declared, in_url, all_dois(text)))
    return F.struct(F.coalesce(F.get(declared, F.lit(0)), F.get(in_url, F.lit(0))).alias("primary_doi"), dois.alias("dois"), arxiv_ids_in_text(text).alias("arxiv_ids"), pdf_links(html, url).alias("pdfs"))


def live_cookies(cookies: Column, now: Column) -> Column:
    """Cookies that have not expired; 0 means for the session."""
    return F.filter(cookies, lambda c: (c["expires"] == 0) | (c["expires"] > now))


def scholar_search_url(query: Column) -> Column:
    """Address of a search for a text at the public scholar search."""
    return F.concat(F.lit("https://scholar.google.com/scholar?q="), percent_encode(query))
