"""Parsing of names typed by people (problem 1); see linking.py for the join."""

from __future__ import annotations

import re
import unicodedata as ud
from dataclasses import dataclass

#: Letters without a decomposition and their plain spelling (fixed values).
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ŧ": "t", "ħ": "h"})
#: English short forms by formal name (fixed values).
SHORT_FORMS = {
    "albert": "al bert bertie", "alexander": "alex sandy xander alec", "andrew": "andy drew", "anthony": "tony", "anton": "toni tony",
    "barbara": "babs barb barbie", "benjamin": "ben benny benji", "catherine": "cathy kate kit katie kathy", "charles": "charlie chuck chas",
    "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "edward": "ed eddie ned ted",
    "eleanor": "ellie nell nellie nora", "elizabeth": "liz beth betty lizzie eliza", "florian": "flo", "frances": "fran francie", "frederick": "fred freddie",
    "gerald": "gerry jerry", "gregory": "greg", "henry": "hank harry hal", "isabella": "bella izzy isa", "jacqueline": "jackie", "james": "jim jamie jimmy",
    "jonathan": "jon jonny", "joseph": "joe joey", "kenneth": "ken kenny", "kimberly": "kim kimmy", "lawrence": "larry lars laurie", "leonard": "len lenny leo",
    "louise": "lou lulu", "margaret": "maggie meg peggy madge", "martha": "marty patty", "matthew": "matt matty", "michael": "mike mick mickey", "nathaniel": "nate nat",
    "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty trish tricia", "peter": "pete", "rebecca": "becky becca", "richard": "dick rick rich richie",
    "robert": "bob bobby rob robbie", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve steph", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "theresa": "terry tess tessa", "thomas": "tom tommy", "victoria": "vicky vic tori", "vincent": "vince vinnie", "walter": "walt wally", "zachary": "zach zack", "william": "bill billy will willie",
}
FORMAL: dict[str, tuple[str, ...]] = {}
for _formal, _short in SHORT_FORMS.items():
    FORMAL.setdefault(_formal, (_formal,))
    for _s in _short.split():
        FORMAL[_s] = (*FORMAL.get(_s, ()), _formal)

PARTICLES = frozenset("van von der den de la del della da di du le al el ten ter bin ibn af av zu zur dela vander".split())
TITLES = frozenset("dr prof professor mr mrs ms sir".split())
SUFFIXES = frozenset("jr sr phd md ed eds ii iii iv esq msc".split())
#: Kinds of organisations (fixed values); short forms are prefixes of them.
KINDS = ("academy", "agency", "association", "bureau", "center", "centre", "college", "committee", "consortium", "council", "department", "foundation", "group", "institute", "laboratory", "ministry", "network", "observatory", "office", "society", "university")
SMALL_WORDS = frozenset("of for the and in on at".split())
#: Particles that lost the space after them.
RUN_ON = re.compile("(?:(?:Dela|Vander|Van|Von|Al|Ten|De|Der|Den|La)(?=[^\\W\\d_a-zà-öø-ÿ]))+(?=[^\\W\\d_a-zà-öø-ÿ][^\\W\\d_A-ZÀ-ÖØ-Þ])")
TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f'’])*\\.?")


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    text = ud.normalize("NFKD", text.lower().translate(PLAIN))
    return "".join(c for c in text if not ud.combining(c)).translate(PLAIN)


SHORT_KINDS = {"acad": "academy", "ag": "agency", "agcy": "agency", "assoc": "association", "cent": "centre", "cen": "centre", "ctr": "centre", "center": "centre", "coll": "college", "comm": "committee", "consort": "consortium", "cons": "consortium", "counc": "council", "dept": "department", "found": "foundation", "inst": "institute", "lab": "laboratory", "min": "ministry", "obs": "observatory", "observ": "observatory", "off": "office", "soc": "society", "univ": "university", "uni": "university"}


def deletions(word: str) -> set[str]:
    """The word and all words one letter shorter."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, substitution or swap of neighbours, or none, makes one word the other."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


class Vocabulary:
    """Common words with their counts; rare words are corrected to a common one at one edit.

    A word with a neighbour ten times as common is no common word but an error made often, unless it is in ``kept``.
    """

    def __init__(self, counts: dict[str, int], kept: frozenset[str] = frozenset(), least_length: int = 4):
        index: dict[str, list[str]] = {}
        for w in counts:
            if len(w) >= least_length:
                for d in deletions(w):
                    index.setdefault(d, []).append(w)
        wrong = {w for w, n in counts.items() if len(w) >= least_length and w not in kept and any(counts[v] >= 10 * n and one_edit(v, w) for d in deletions(w) for v in index.get(d, ()))}
        self.counts = {w: n for w, n in counts.items() if w not in wrong}
        self.index = {d: left for d, ws in index.items() if (left := [w for w in ws if w not in wrong])}
        self.known: dict[str, str | None] = {}

    def nearest(self, word: str) -> str | None:
        """The word if common, else the commonest common word at one edit, else None."""
        if word in self.counts:
            return word
        if len(word) < 4:
            return None
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            near = {w for d in deletions(word) for w in self.index.get(d, ()) if one_edit(w, word)}
            self.known[word] = max(near, key=lambda w: (self.counts[w], w)) if near else None
        return self.known[word]


@dataclass(frozen=True, slots=True)
class Name:
    """A parsed name. ``org``: whether of an organisation; ``anchor``: surname or place tokens; ``rest``: given names or topics, short ones with a dot."""

    org: bool
    anchor: tuple[str, ...]
    rest: tuple[str, ...]
    kind: str = ""


def _raw_tokens(text: str) -> list[str]:
    # A capital inside a word starts a word that lost its space: "DelaFos" but not "McFos".
    return TOKEN.findall(text)


def is_initials(token: str, whole_upper: bool) -> bool:
    """One letter, or two or three capitals run together."""
    t = token.rstrip(".")
    return len(t) == 1 or (len(t) <= 3 and t.isupper() and not (whole_upper and len(t) > 2))


def parse(last: str | None, first: str | None, single: str | None, given: Vocabulary) -> Name | None:
    """The parts of a name in two-field or single-field form; None if there is none. ``given``: known given names."""
    last, first, single = (" ".join((x or "").replace("(Ed.)", " ").split()) for x in (last, first, single))
    text = single or f"{last} {first}".strip()
    if not any(c.isalpha() for c in text):
        return None
    words = _raw_tokens(text)
    folded = [fold(w) for w in words]
    bare = [w.rstrip(".") for w in folded]
    if looks_like_organisation(text, words, bare):
        return _organisation(single or (last if not first else f"{last} {first}"))
    return _person(last, first, single, given)


def looks_like_organisation(text: str, words: list[str], bare: list[str]) -> bool:
    """A small word of titles, a kind, or a mark that persons' names do not have."""
    if len(bare) < 3:
        return False
    return bool(SMALL_WORDS & {w for w, r in zip(bare, words, strict=True) if r[0].islower() or r.isupper() or r == "The" or len(bare) > 3}) or any(w in KINDS or w in SHORT_KINDS for w in bare[:3]) or ":" in text or "&" in text


def _organisation(text: str) -> Name:
    text = re.sub(r"\([^)]*\)", " ", text)
    head, _, tail = text.partition(",")
    words = [w for w in _raw_tokens(f"{tail} {head}") if fold(w).rstrip(".") not in SMALL_WORDS]
    toks = [fold(w) for w in words]
    kind, at = "", -1
    for i, t in enumerate(toks[:4]):
        b = t.rstrip(".")
        k = SHORT_KINDS.get(b) or (b if b in KINDS else "")
        if k:
            kind, at = k, i
            break
    if at < 0:
        at = 1
        kind = toks[1].rstrip(".") if len(toks) > 1 else ""
    anchor = tuple(t.rstrip(".") for t in toks[:at])
    return Name(True, anchor or (toks[0],), tuple(toks[at + 1 :]), kind)


def _person(last: str, first: str, single: str, given: Vocabulary) -> Name | None:
    upper = (single or last + first).isupper()
    doubtful: list[str] = []

    def clean(text: str) -> list[str]:
        out = []
        for w in _raw_tokens(text):
            f = fold(w).replace("'", "").replace("’", "")
            b = f.rstrip(".")
            if not b:
                continue
            if not upper and len(w) == 2 and w.isupper() and (b in TITLES or b in SUFFIXES or b in PARTICLES):
                # Two capitals: initials, if nothing else turns out to be the given name.
                doubtful.extend(c + "." for c in b)
            elif b in TITLES and (w.endswith(".") or w[0].isupper()) or b in SUFFIXES and not (b == "ed" and not w.endswith(".") and w[0].isupper()):
                continue
            elif is_initials(w, upper) and b not in PARTICLES:
                out.extend(c + "." for c in b)
            else:
                if b == "al" and w == "Al":
                    doubtful.append("al")
                m = RUN_ON.match(w) if len(w) > 5 and w[0] in "DVAT" else None
                out.append(fold(w[m.end() :]) if m else f)
        return out

    def initial(t: str) -> bool:
        return len(t) == 2 and t[1] == "."

    def known(t: str) -> bool:
        return initial(t) or t in FORMAL or given.nearest(t) is not None or (t.endswith(".") and len(t) > 2)

    def content(ts: list[str]) -> list[str]:
        return [t for t in ts if t not in PARTICLES]

    if single:
        head, comma, tail = single.partition(",")
        tail_t = content(clean(tail))
        if comma and tail_t:
            sur, giv = content(clean(head)), tail_t
        else:
            ts = content(clean(head))
            if not ts:
                return Name(False, tuple(fold(w).rstrip(".") for w in _raw_tokens(single)), ())
            # The surname is the last word that is no given name; one after initials, or before them.
            k = next((i for i in range(len(ts) - 1, -1, -1) if not known(ts[i])), None)
            if k is None:
                k = next((i for i in range(len(ts) - 1, -1, -1) if not initial(ts[i])), len(ts) - 1)
            lo = k
            while lo > 1 and not known(ts[lo - 1]):
                lo -= 1
            if lo == 1 and not known(ts[0]) and k == 1 and len(ts) == 2:
                lo = 1
            sur, giv = ts[lo : k + 1], ts[:lo] + ts[k + 1 :]
    else:
        sur, giv = content(clean(last)), content(clean(first))
        if sur and giv and all(map(known, sur)) and not all(map(known, giv)):
            sur, giv = giv, sur
        if not sur:
            sur, giv = giv, []
            if len(sur) > 1:
                sur, giv = sur[-1:], sur[:-1]
        # A given name typed into the surname field, or the other way round.
        if len(sur) > 1 and not giv:
            k = [t for t in sur if not known(t)]
            giv = [t for t in sur if known(t)] if k else sur[:-1]
            sur = k or sur[-1:]
        else:
            moved = [t for t in sur if initial(t)]
            if moved and len(moved) < len(sur):
                sur = [t for t in sur if not initial(t)]
                giv = giv or moved
        if len(giv) > 1 and not known(giv[-1]) and any(map(known, giv[:-1])) and all(map(known, sur)):
            sur, giv = giv[-1:], giv[:-1] + sur
    sur = [t.rstrip(".") for t in sur]
    giv = giv or doubtful
    if not sur:
        # Nothing but particles and titles: then they are the name.
        sur, giv = [fold(w).rstrip(".") for w in _raw_tokens(single or last or first)], []
    return Name(False, tuple(sur), tuple(giv)) if sur else None
