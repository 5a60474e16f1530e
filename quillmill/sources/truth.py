"""Ground truth of a paper from its LaTeX sources: included files, the list it cites, its own metadata."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.sources import latex

DEPTH = 5
#: Commands that put in another file, as whole words (fixed values).
INCLUDING = re.compile("|".join(rf"\\{c}(?![A-Za-z])" for c in ("input", "include", "subfile")))


def _argument(text: str, at: int) -> tuple[str | None, int]:
    """A command's argument from a position on, in braces or as the bare word after white space, and where it ends."""
    start = at
    while start < len(text) and text[start].isspace():
        start += 1
    if start < len(text) and text[start] == "{":
        end = text.find("}", start)
        return (None, at) if end < 0 else (text[start + 1 : end].strip(), end + 1)
    end = start
    while end < len(text) and not text[end].isspace() and text[end] not in "\\{}%":
        end += 1
    return (text[start:end], end) if start > at and end > start else (None, at)


def resolve_inputs(files: dict[str, str], main: str, depth: int = DEPTH) -> str:
    """A source with its ``\\input`` and ``\\include`` files put in, to a fixed depth; unknown files vanish."""

    def put_in(text: str, left: int) -> str:
        if left == 0:
            return text

        out, at = [], 0
        for command in INCLUDING.finditer(text):
            if command.start() < at:
                continue
            name, end = _argument(text, command.end())
            if name is None:
                continue
            body = files.get(name) or files.get(name + ".tex")
            out += [text[at : command.start()], put_in(latex.strip_comments(body), left - 1) if body is not None else ""]
            at = end
        return "".join(out) + text[at:]

    return put_in(latex.strip_comments(files.get(main, "")), depth)


def main_file(files: dict[str, str]) -> str | None:
    """The file that begins the document, the longest if several do."""
    starts = [n for n, t in files.items() if n.endswith(".tex") and "\\begin{document}" in t]
    return max(starts, key=lambda n: (len(files[n]), n), default=None)


def paper_truth(tex: str) -> dict:
    """Title and authors that a source states."""

    def argument(command: str) -> str | None:
        m = re.search(rf"\\{command}\*?\s*(?:\[[^\]]*\])?\s*\{{", tex)
        if not m:
            return None
        depth, n = 1, m.end()
        while n < len(tex) and depth:
            depth += (tex[n] == "{") - (tex[n] == "}")
            n += 1
        return tex[m.end() : n - 1]

    title, author = argument("title"), argument("author")
    names = [latex.latex_to_text(re.sub(r"\\(?:thanks|footnote|inst|email|affil)\s*\{[^{}]*\}|\$[^$]*\$", "", a)) for a in re.split(r"\\and\b|,\s+and\s+|\s+and\s+|,", author)] if author else []
    return {"title": latex.latex_to_text(title) if title else None, "authors": [a for a in names if re.search(r"[^\W\d_]{2}", a)]}


TRUTH = f"title string, authors array<string>, method string, refs array<{latex.REF}>, cited array<string>"


def ground_truth(sources: DataFrame, paper: str = "paper_id") -> DataFrame:
    """``(paper, title, authors, method, refs, cited)`` from (paper, path, text); one paper's files are a bounded group.

    The typeset list comes first, then the database's entries that are cited, then all of them; cited entries that
    the typeset list lacks are added from the database.
    """
    kind = dict(sources.dtypes)[paper]

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        files = {p.removeprefix("./"): t for p, t in zip(d["path"], d["text"], strict=True) if isinstance(t, str)}
        main = main_file(files)
        tex = resolve_inputs(files, main) if main else "\n".join(t for n, t in sorted(files.items()) if n.endswith(".tex"))
        groups = re.findall(r"\\(?:no|paren|text|foot|auto|full)?[cC]ite(?:p|t|alp|alt|author|year|num)?\*?\s*(?:\[[^\]]*\]\s*){0,2}\{([^}]*)\}", tex)
        cited = list(dict.fromkeys(k.strip() for g in groups for k in g.split(",") if k.strip()))
        bbl = [e for n, t in sorted(files.items()) if n.endswith(".bbl") or "\\begin{thebibliography}" in t for e in latex.bbl_entries(t)]
        first: dict[str, dict] = {}
        for n, t in sorted(files.items()):
            for e in latex.bib_entries(t) if n.endswith(".bib") else ():
                first.setdefault(e["key"], e)
        bib = list(first.values())
        have, wanted = {e["key"] for e in bbl}, set(cited)
        missing = [e for e in bib if e["key"] in wanted and e["key"] not in have]
        if bbl:
            refs, method = bbl + missing, "bbl"
        elif missing and "*" not in wanted:
            refs, method = missing, "cited"
        else:
            refs, method = bib, "all" if bib else "none"
        p = paper_truth(tex)
        return pd.DataFrame([(key[0], p["title"], p["authors"], method, refs, [k for k in cited if k != "*"])], columns=[paper, "title", "authors", "method", "refs", "cited"])

    return sources.groupBy(paper).applyInPandas(run, f"{paper} {kind}, {TRUTH}")


def missing_keys(truth: DataFrame, paper: str = "paper_id") -> DataFrame:
    """``(paper, key)``: cited keys without an entry."""
    cited = truth.select(paper, F.explode("cited").alias("key"))
    return cited.join(truth.select(paper, F.explode("refs.key").alias("key")), [paper, "key"], "left_anti")


def first_of_key(refs: DataFrame, paper: str = "paper_id", key: str = "key", order: str = "pos") -> DataFrame:
    """The first entry of each key."""
    w = Window.partitionBy(paper, key).orderBy(order)
    return refs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
