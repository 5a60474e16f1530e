"""Text expressions: normal forms, line predicates and similarity, all inside Catalyst.

Null in gives null out, unless a docstring says otherwise. Positions and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = r"[\p{IsAlphabetic}\p{N}]"
NOT_ALNUM = r"[^\p{IsAlphabetic}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(c: Column | str) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def normalize_title(c: Column | str) -> Column:
    """Lower-case letters and digits, runs of anything else as one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), NOT_ALNUM, " "))


def words(c: Column | str) -> Column:
    """The words of the normal form; empty for a text without any."""
    return F.filter(F.split(normalize_title(c), " "), lambda w: w != "")


def word_set(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(words(c)))


def tokens(c: Column | str) -> Column:
    """Runs of non-space characters."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")


def digit_key(c: Column | str) -> Column:
    """Key of a running head: digit runs masked, white space collapsed."""
    return F.regexp_replace(collapse_space(c), "[0-9]+", "#")


def squash(c: Column | str) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(col(c), r"\s", ""))


def leading_words(c: Column | str, n: int) -> Column:
    """The first n words, joined by single spaces."""
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def truncate_chars(c: Column | str, n: int, mark: str = " […]") -> Column:
    """At most n characters, a mark after a cut."""
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(mark))).otherwise(x)


def fts_terms(c: Column | str) -> Column:
    """Search terms of a query: letter and digit runs, lower case."""
    return F.filter(F.split(F.lower(col(c)), NOT_ALNUM), lambda w: w != "")


def fts_query(c: Column | str) -> Column:
    """Quoted terms joined by OR; null if there is none."""
    runs = F.filter(F.split(col(c), NOT_ALNUM), lambda w: w != "")
    return F.when(F.size(runs) > 0, F.array_join(F.transform(runs, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR "))


def is_page_number(c: Column | str) -> Column:
    """An Arabic number, ``Page n of m`` or a roman number alone."""
    t = F.trim(col(c))
    return t.rlike(r"^(?i)(?:page\s+)?[-–—]?\s*[0-9]{1,4}\s*[-–—]?(?:\s*(?:of|/)\s*[0-9]{1,4})?$") | t.rlike(r"^(?i)(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$")


def is_toc(c: Column | str) -> Column:
    """A contents line: ends in a digit and holds at least four leaders."""
    t = col(c)
    leaders = F.regexp_count(t, F.lit(r" \.")) + F.regexp_count(t, F.lit(r"\.\.")) + F.regexp_count(t, F.lit("…"))
    return t.rlike("[0-9]$") & (leaders >= 4)


def caption_kind(c: Column | str) -> Column:
    """figure, table or algorithm if the line opens a caption, else null."""
    t = F.trim(col(c))
    number = r"\s*(?:[0-9]+(?:\.[0-9]+)*|[IVXL]+|[A-Z]\.?[0-9]+)\s*[.:|–—-]"
    return F.when(t.rlike(rf"^(?:Fig(?:ure|\.)?|FIG(?:URE|\.)?|Abb(?:ildung|\.)?){number}"), "figure").when(t.rlike(rf"^(?:Tab(?:le|\.)?|TAB(?:LE|\.)?|Tabelle){number}"), "table").when(t.rlike(rf"^(?:Algorithm|ALGORITHM){number}"), "algorithm")


def numeric_token(c: Column) -> Column:
    """A number, also with sign, separators, percent, exponent or plus-minus part."""
    t = F.regexp_replace(c, r"^[(\[{<>≤≥~≈=±,;:*†‡]+|[)\]},;:*†‡]+$", "")
    return t.rlike(r"^[-+−±]?(?:[0-9]+(?:[.,][0-9]+)*|\.[0-9]+)(?:[eE×x][-+−]?[0-9]+)?(?:[±/–-][0-9.,]+)*[%‰°kKMB]?$")


def numeric_share(c: Column | str) -> tuple[Column, Column]:
    """(numeric words, words)."""
    ts = tokens(c)
    return F.size(F.filter(ts, numeric_token)), F.size(ts)


def is_axis_like(c: Column | str) -> Column:
    """At least one number and at most one other word."""
    n, all_ = numeric_share(c)
    return (n >= 1) & (all_ - n <= 1)


def is_mostly_numeric(c: Column | str) -> Column:
    """At least six words in ten are numbers."""
    n, all_ = numeric_share(c)
    return (all_ > 0) & (n * 10 >= all_ * 6)


def is_fragment(c: Column | str) -> Column:
    """At most four words, or like an axis, or mostly numbers."""
    return (F.size(tokens(c)) <= 4) | is_axis_like(c) | is_mostly_numeric(c)


def lower_words(c: Column | str) -> Column:
    """Number of words that open with a lower-case letter."""
    return F.size(F.filter(tokens(c), lambda w: w.rlike(r"^\p{Ll}")))


def is_prose(c: Column | str) -> Column:
    """At least six words, half of them in lower case, fewer than three in ten numbers."""
    n, all_ = numeric_share(c)
    return (all_ >= 6) & (lower_words(c) * 2 >= all_) & (n * 10 < all_ * 3)


def is_prose_like(c: Column | str) -> Column:
    """At least seven words, at most three in ten numbers, at most two in capitals, at least two in lower case."""
    n, all_ = numeric_share(c)
    capitals = F.size(F.filter(tokens(c), lambda w: w.rlike(r"^\p{Lu}{2,}[^\p{L}]*$")))
    return (all_ >= 7) & (n * 10 <= all_ * 3) & (capitals <= 2) & (lower_words(c) >= 2)


def opens_sentence(c: Column | str) -> Column:
    """Opens with a capital, has at least ten words and reads like prose."""
    return F.trim(col(c)).rlike(r"^\p{Lu}") & (F.size(tokens(c)) >= 10) & is_prose_like(c)


def ends_sentence(c: Column | str) -> Column:
    """Ends in a stop, closing marks aside."""
    return col(c).rlike(r"[.?!][\"'”’)\]]*\s*$")


def is_algorithm_line(c: Column | str) -> Column:
    """Pseudo-code: an assignment arrow or one of the usual openings."""
    t = F.trim(col(c))
    return t.rlike(r"←|:=|▷|⊳") | t.rlike(r"^(?i)(?:[0-9]+\s*[:.]?\s*)?(?:if\b.*\bthen|else\b|end\b|for\b.*\bdo|for each\b|foreach\b|while\b.*\bdo|repeat\b|until\b|return\b|require:?|ensure:?|input:|output:|procedure\b|function\b)")


def is_math_line(c: Column | str) -> Column:
    """At most two ordinary words beside a mathematical sign."""
    t = col(c)
    ordinary = F.size(F.filter(tokens(c), lambda w: w.rlike(r"^\p{L}{3,}[.,;:]?$")))
    return (ordinary <= 2) & t.rlike(r"[=<>≤≥≈≡∈∑∏∫√±×·∂∇∞→↦⊂⊆∪∩∀∃^_{}]|\p{Sm}")


def is_math_token(c: Column) -> Column:
    """A token without letters, with a mathematical sign, or a single letter other than a and i."""
    return (~c.rlike(r"\p{L}")) | c.rlike(r"[=<>≤≥≈∈∑∏∫√±×∂∇∞→^_\\{}]") | c.rlike(r"^[b-hj-zB-HJ-Z]$")


def alignment_words(c: Column | str) -> Column:
    """Tokens compared by word alignment: lower case, no punctuation at the ends, no mathematics."""
    trimmed = F.transform(F.filter(tokens(c), lambda w: ~is_math_token(w)), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(trimmed, lambda w: w != "")


def is_math_heavy(c: Column | str) -> Column:
    """Not fewer other characters than letters, white space aside."""
    t = F.regexp_replace(col(c), r"\s", "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) > 0) & (F.length(t) - letters >= letters)


def script_form(c: Column | str, raised: bool) -> Column:
    """Digits, signs and a few letters as superscripts or subscripts; null where a character has no such form."""
    t = col(c)
    if raised:
        return F.when(t.rlike(r"^[0-9+\-=()ni]+$"), F.translate(t, "0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"))
    return F.when(t.rlike(r"^[0-9+\-=()aeox]+$"), F.translate(t, "0123456789+-=()aeox", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓ"))


def join_break_hyphens(c: Column | str) -> Column:
    """Drops a hyphen with white space after it between two letters."""
    return F.regexp_replace(col(c), r"(?<=\p{L})-\s+(?=\p{L})", "")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def digit_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit("[0-9]+"), F.lit(0))


def digits_conflict(a: Column, b: Column) -> Column:
    """Each of two titles holds a digit run that the other lacks."""
    return (F.size(F.array_except(digit_runs(a), digit_runs(b))) > 0) & (F.size(F.array_except(digit_runs(b), digit_runs(a))) > 0)


def title_overlap(title: Column, entry: Column) -> Column:
    """Share of a title's distinct words of four letters or more that occur in an entry; null for fewer than two."""
    long = F.array_distinct(F.filter(words(title), lambda w: F.length(w) >= 4))
    return F.when(F.size(long) >= 2, F.size(F.array_intersect(long, words(entry))) / F.size(long))


def ratio(num: Column, den: Column) -> Column:
    """A quotient, 0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def line_of_offset(c: Column | str, offset: Column) -> Column:
    """Number, from 0, of the line that holds a character offset; null past the end."""
    t = col(c)
    head = F.left(t, offset)
    return F.when((offset >= 0) & (offset <= F.length(t)), F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))))
