"""Truth references out of LaTeX sources: bibliography databases, typeset lists, citation commands, plain text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.session import batch_udf

REF = "struct<key:string,label:string,text:string,authors:array<string>,title:string,year:int,doi:string,arxiv_id:string,source:string>"
_ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊"}
_SYMBOLS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å", "i": "i", "j": "j", "&": "&", "%": "%", "_": "_", "#": "#", "$": "$", "textendash": "–", "textemdash": "—", "ldots": "…", "dots": "…"}


def strip_comments(tex: str) -> str:
    """Without comments; an escaped percent sign stays."""
    return re.sub(r"(?<!\\)((?:\\\\)*)%[^\n]*", r"\1", tex)


def latex_to_text(tex: str) -> str:
    """Readable text: accents composed, commands dropped, arguments kept."""
    import unicodedata

    t = strip_comments(tex)
    t = re.sub(r"\\([`'^\"~=.uvHckr])\s*(?:\{\s*\\?([a-zA-Z])\s*\}|\\?([a-zA-Z]))", lambda m: (m[2] or m[3]) + _ACCENTS[m[1]] if m[1] in "`'^\"~=." or m[2] else m[0], t)
    t = re.sub(r"\\(?:([a-zA-Z]+)(?:\s*\{\}|\s+)?|([&%_#$]))", lambda m: _SYMBOLS.get(m[1] or m[2], " " if m[1] in ("newblock", "par", "quad", "linebreak", "newline", "bibinfo") else ""), t)
    t = t.replace("~", " ").replace("``", "“").replace("''", "”").replace("---", "—").replace("--", "–").replace("\\\\", " ").replace("\\", "")
    return " ".join(unicodedata.normalize("NFC", re.sub(r"[{}$]", "", t)).split())


def _fields(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    i = 0
    for m in re.finditer(r"([A-Za-z_-]+)\s*=\s*", body):
        if m.start() < i:
            continue
        k, j = m[1].lower(), m.end()
        if j >= len(body):
            break
        if body[j] in '{"':
            close, depth, n = "}" if body[j] == "{" else '"', 0, j + 1
            while n < len(body) and not (body[n] == close and depth == 0):
                depth += (body[n] == "{") - (body[n] == "}" and depth > 0)
                n += 1
            value, i = body[j + 1 : n], n + 1
        else:
            v = re.match(r"[^,}\s]+", body[j:])
            value, i = (v[0], j + v.end()) if v else ("", j)
        out.setdefault(k, value.strip())
    return out


def bib_entries(text: str) -> list[dict]:
    """Entries of a BibTeX database."""
    out = []
    for m in re.finditer(r"@(\w+)\s*[{(]\s*([^,\s]+)\s*,", text):
        if m[1].lower() in ("string", "comment", "preamble"):
            continue
        depth, n = 1, m.end()
        while n < len(text) and depth:
            depth += (text[n] == "{") - (text[n] == "}")
            n += 1
        f = _fields(text[m.end() : n - 1])
        year = re.search(r"(?:1[5-9]|20)\d\d", f.get("year", "") or f.get("date", ""))
        arxiv = f.get("eprint") if f.get("archiveprefix", "").lower() == "arxiv" or re.fullmatch(r"\d{4}\.\d{4,5}(v\d+)?", f.get("eprint", "")) else None
        authors = [latex_to_text(a) for a in re.split(r"\s+and\s+", f.get("author", "")) if a.strip() and a.strip() != "others"]
        title = latex_to_text(f["title"]) if f.get("title") else None
        parts = [", ".join(authors), title, latex_to_text(f.get("journal") or f.get("booktitle") or ""), f.get("year", "")]
        out.append({"key": m[2], "label": None, "text": ". ".join(p for p in parts if p), "authors": authors, "title": title, "year": int(year[0]) if year else None, "doi": (f.get("doi") or "").lower() or None, "arxiv_id": arxiv, "source": "bib"})
    return out


def bbl_entries(text: str) -> list[dict]:
    """Entries of a typeset list."""
    out = []
    body = strip_comments(text)
    body = re.split(r"\\end\{thebibliography\}", body)[0]
    for m in re.finditer(r"\\bibitem\s*(?:\[((?:[^\[\]{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\])?\s*\{([^}]*)\}(.*?)(?=\\bibitem|\Z)", body, re.S):
        raw = m[3]
        doi = re.search(r"10\.\d{4,9}/[^\s{}\"<>,]+", raw)
        arxiv = re.search(r"(?:arXiv:|abs/)(\d{4}\.\d{4,5}|[a-z-]+/\d{7})", raw)
        blocks = [latex_to_text(b).strip(" .,") for b in re.split(r"\\newblock", raw)]
        text_ = latex_to_text(raw)
        year = re.search(r"\((?:1[5-9]|20)\d\d", text_) or re.search(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)", text_)
        authors = [a.strip() for a in re.split(r",?\s+and\s+|,\s+(?=[^\W\d_]\.)|,\s+", blocks[0]) if re.search(r"[^\W\d_]{2}", a)] if len(blocks) > 1 else []
        out.append({"key": m[2].strip(), "label": latex_to_text(m[1]) if m[1] else None, "text": text_, "authors": authors, "title": blocks[1] if len(blocks) > 1 else None, "year": int(re.search(r"\d{4}", year[0])[0]) if year else None, "doi": doi[0].lower().rstrip(".") if doi else None, "arxiv_id": arxiv[1] if arxiv else None, "source": "bbl"})
    return out


@batch_udf(f"array<{REF}>")
def parse_bib(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bib_entries(t) if isinstance(t, str) else [])


@batch_udf(f"array<{REF}>")
def parse_bbl(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: bbl_entries(t) if isinstance(t, str) else [])


@batch_udf("string")
def to_text(texts: pd.Series) -> pd.Series:
    return texts.map(latex_to_text, na_action="ignore")


def cited_keys(tex: Column) -> Column:
    """Keys of all citation commands, in order, with repeats; comments do not count."""
    clean = F.regexp_replace(tex, r"(?<!\\)%[^\n]*", "")
    groups = F.regexp_extract_all(clean, F.lit(r"\\(?:no|paren|text|foot|auto|full)?[cC]ite(?:p|t|alp|alt|author|year|yearpar|num)?\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]*)\}"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda t: F.trim(t)), lambda k: (k != "") & (k != "*"))


def body_text(main: Column) -> Column:
    """What stands between the beginning and end of the document, before its list."""
    inner = F.regexp_extract(main, r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\\begin\{thebibliography\}|\\bibliography\{|$)", 1)
    return to_text(F.regexp_replace(inner, r"(?s)\\begin\{(equation|align|figure|table|tabular)\*?\}.*?\\end\{\1\*?\}", " "))
