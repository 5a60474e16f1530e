"""What a bibliography entry says about the work it cites (problem 3)."""

from __future__ import annotations

import re
import unicodedata as ud
from dataclasses import dataclass
from functools import lru_cache

from quillmill.llm.confusables import CYRILLIC, GREEK, HYPHENS, OVERLAYS, consistent, invisible, unusual_form
from quillmill.llm.names import PARTICLES, PLAIN, one_edit

WORDS = re.compile(r"[^\W\d_]+|\d+")
LETTERS = re.compile(r"[^\W\d_]+")
BROKEN = re.compile(r"(?<=[^\W\d_])-\s+(?=[^\W\d_])")
MIXED = re.compile("[" + "".join(CYRILLIC) + "".join(GREEK) + "]")
#: Openings of titles that make a work of its own out of another's title, without spaces (fixed values).
DERIVED = {
    "correctionto": "correction", "correctionof": "correction", "erratum": "correction", "corrigendum": "correction", "berichtigung": "correction", "поправка": "correction", "исправление": "correction",
    "replyto": "reply", "responseto": "reply", "commenton": "comment", "commentson": "comment", "ответназамечания": "reply", "retractionof": "retraction", "retracted": "retraction",
    "extendeddata": "data", "supplementto": "data", "supplementary": "data", "datafor": "data", "appendixto": "data", "данныекстатье": "data",
}
OPENINGS: dict[str, list[tuple[str, str]]] = {}
for _opening, _kind in DERIVED.items():
    OPENINGS.setdefault(_opening[0], []).append((_opening.replace("rn", "m").replace("cl", "d"), _kind))
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
PART = re.compile(r"(?:\bpart ?|, ?)([ivxl1]{1,5}|\d{1,2})\W*$")
PART_INSIDE = re.compile(r"\bpart ?([ivx]{1,5}|\d{1,2})\b")
COMMON = frozenset("a an and as at by de der des die du ein eine el en et for from how in la le les los mit of on the to und une vol pp al with zur bei im di".split())
YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")


class _Folding(dict):
    """Translation table that folds a character when it is first seen."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        if invisible(ch) or ch in OVERLAYS or ud.combining(ch):
            out = ""
        elif ch in HYPHENS:
            out = "-"
        elif ch.isspace():
            out = " "
        else:
            low = (ud.normalize("NFKC", ch) if unusual_form(ch) else ch).lower().translate(PLAIN)
            out = "".join(c for c in ud.normalize("NFD", low) if not ud.combining(c))
        self[cp] = out
        return out


FOLDING = _Folding()


def plain(text: str | None) -> str:
    """Folded text in ordinary characters, words broken at line ends joined."""
    if not text:
        return ""
    if not text.isascii():
        if MIXED.search(text):
            text = consistent(text)
        text = text.translate(FOLDING)
    else:
        text = text.lower()
    return BROKEN.sub("", text) if "- " in text or "-\n" in text else text


@lru_cache(maxsize=100_000)
def surname_key(name: str) -> str:
    """One word that stands for a name: the longest part of a person's surname, the longest word of a long name."""
    head, comma, _ = plain(name).partition(",")
    words = [w for w in head.split() if w not in PARTICLES and len(w) > 2 and "." not in w[:-1]]
    if not comma and len(words) < 4:
        words = words[-1:]
    if len(words) == 1 and words[0].isalpha():
        return words[0]
    return max((p for w in words for p in LETTERS.findall(w)), key=len, default="")


def squeeze(words: str) -> str:
    """The letters and digits of a plain title's words, the common misreadings of letters as digits undone."""
    out = words.replace(" ", "")
    if not out.isalpha():
        out = out.replace("0", "o").replace("1", "l")
    return out.replace("rn", "m").replace("cl", "d")


def kind_of_work(squeezed: str) -> str:
    """The kind of derived work that a title opens with, one error allowed."""
    for opening, kind in OPENINGS.get(squeezed[:1], ()):
        if squeezed.startswith(opening) or any(one_edit(squeezed[:n], opening) for n in (len(opening), len(opening) - 1, len(opening) + 1)):
            return kind
    return ""


def part_of_series(title: str) -> int:
    """Number of the part, 0 for none."""
    found = PART.search(title.rstrip()) if "part" in title or title.rstrip()[-1:] in "ivx1l" else None
    if not found:
        inside = PART_INSIDE.findall(title)
        return ROMAN.get(inside[-1], int(inside[-1]) if inside[-1].isdigit() else 0) if inside else 0
    p = found[1]
    if p.isdigit() and len(p) < 3 and "part" in title and not set(p) <= {"1"}:
        return int(p)
    return ROMAN.get(p.replace("1", "i").replace("l", "i"), 0)


def doi_key(doi: str | None) -> str:
    """Bare identifier in lower case."""
    if not doi:
        return ""
    m = re.search(r"10\.\d{3,9}/\S+", doi.lower())
    return m.group().rstrip(".,;)") if m else ""


def venue_initials(venue: str) -> str:
    """First letters of the words of a venue, the same for its short form."""
    return "".join(w[0] for w in LETTERS.findall(venue) if w not in COMMON)[:8]


@lru_cache(maxsize=20_000)
def read_venue(venue: str | None) -> tuple[str, str]:
    """A venue in ordinary characters, and its initials."""
    v = plain(venue).strip()
    return v, venue_initials(v)


@dataclass(slots=True)
class Entry:
    """``words``: of the title, "" if unknown; ``kind``: of derived work; ``part``: of a series, 0 for none; ``numbers``: volume, issue, pages. Lists are joined by spaces."""

    words: str
    kind: str
    part: int
    surnames: str
    year: int | None
    numbers: str
    venue: str
    doi: str


def _entry(title: str, surnames: list[str], year: int | None, numbers: list[str], venue: str, doi: str | None) -> Entry:
    words = " ".join(WORDS.findall(title))
    kind = kind_of_work(squeeze(words)) if words else ""
    return Entry(words, kind, part_of_series(title) if words else 0, " ".join(surnames), year, " ".join(numbers), venue, doi_key(doi))


def read_source(text: str | None, authors: list[str] | None, surname: str | None, title: str | None, year: int | None, doi: str | None) -> Entry:
    """An entry as the citing author's source gives it; its numbers and venue stand after the title."""
    body, t = plain(text), plain(title).strip()
    names = [k for k in dict.fromkeys(map(surname_key, authors or ([surname] if surname else []))) if k and k != "anonymous"]
    end = t[-20:]
    at = body.rfind(end) if len(t) >= 8 else -1
    if at >= 0:
        tail = body[at + len(end) :]
    else:
        parts = body.split(". ")
        head = next((i for i in range(1, len(parts)) if len(parts[i]) > 16), 0)
        t = t or (parts[head] if head else "")
        tail = ". ".join(parts[head + 1 :]) if head else ""
    tail = tail.split("doi")[0]
    numbers = [w for w in WORDS.findall(tail) if w[0].isdigit()]
    if numbers and YEAR.fullmatch(numbers[0]) and (year is None or int(numbers[0]) == year):
        year = int(numbers.pop(0))
    return _entry(t, names, year, numbers[:4], venue_initials(tail), doi)


def read_extracted(raw: str | None, authors: list[str] | None, surname: str | None, title: str | None, year: int | None, venue: str | None, volume: str | None, issue: str | None, pages: str | None, doi: str | None) -> Entry:
    """An entry read out of a document; a title that was not found is looked for in the raw text."""
    t = plain(title).strip()
    names = [k for k in dict.fromkeys(map(surname_key, authors or ([surname] if surname else []))) if k]
    numbers = [n for f in (volume, issue, pages) if f for n in WORDS.findall(f) if n.isdigit()]
    v, initials = read_venue(venue)
    if t and len(v) > 6 and t.rstrip(". ").endswith(v.rstrip(". ")):
        t = t.rstrip(". ")[: -len(v.rstrip(". "))]
    if not t or year is None:
        body = plain(raw)
        if not t:
            t = _title_inside(body, names, v)
        if year is None:
            rest = [y for y in YEAR.findall(body) if y not in numbers]
            year = int(rest[0]) if rest else None
    return _entry(t, names, year, numbers[:4], initials, doi)


def _title_inside(body: str, names: list[str], venue: str) -> str:
    """The longest stretch between stops that holds no author and no venue, "" if none is long."""
    best = ""
    for piece in re.split(r"[.“”\"]\s|:\s|,\s|\(\d{4}\)|;\s", body):
        if len(piece) > len(best) and not any(n in piece for n in names) and not (venue and venue[:12] in piece):
            best = piece
    words = LETTERS.findall(best)
    return best if len(best) > 24 and len(words) >= 4 else ""
