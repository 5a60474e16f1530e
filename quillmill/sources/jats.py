"""Truth references out of JATS articles. Malformed XML gives none."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd

from quillmill.session import batch_udf

REF = "struct<idx:int,key:string,label:string,text:string,authors:array<string>,title:string,year:int,venue:string,volume:string,issue:string,first_page:string,last_page:string,doi:string,pmid:string>"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(e: ET.Element | None) -> str | None:
    return " ".join("".join(e.itertext()).split()) or None if e is not None else None


def article_references(xml: str) -> list[dict]:
    """References of an article in list order."""
    if "<!ENTITY" in xml or "<!DOCTYPE" in xml and "[" in xml.split("<!DOCTYPE", 1)[1].split(">", 1)[0]:
        return []
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml))
    except ET.ParseError:
        return []
    out = []
    for ref in (e for e in root.iter() if _name(e.tag) == "ref"):
        cit = next((e for e in ref.iter() if _name(e.tag) in ("mixed-citation", "element-citation", "citation")), ref)
        first = {}
        for e in cit.iter():
            first.setdefault(_name(e.tag), e)
        authors = []
        for e in cit.iter():
            if _name(e.tag) in ("name", "string-name"):
                parts = {_name(c.tag): _text(c) for c in e}
                authors.append(" ".join(filter(None, (parts.get("given-names"), parts.get("surname")))) or _text(e))
            elif _name(e.tag) == "collab":
                authors.append(_text(e))
        ids = {e.get("pub-id-type"): _text(e) for e in cit.iter() if _name(e.tag) == "pub-id"}
        year = re.search(r"(?:1[5-9]|20)\d\d", _text(first.get("year")) or "")
        out.append({
            "idx": len(out), "key": ref.get("id"), "label": next((_text(e) for e in ref if _name(e.tag) == "label"), None), "text": _text(cit), "authors": [a for a in authors if a], "title": _text(first.get("article-title")) or _text(first.get("chapter-title")),
            "year": int(year[0]) if year else None, "venue": _text(first.get("source")), "volume": _text(first.get("volume")), "issue": _text(first.get("issue")), "first_page": _text(first.get("fpage")), "last_page": _text(first.get("lpage")), "doi": (ids.get("doi") or "").lower() or None, "pmid": ids.get("pmid"),
        })
    return out


@batch_udf(f"array<{REF}>")
def parse_jats(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: article_references(t) if isinstance(t, str) else [])
