"""Problem 2: text that looks ordinary but is made of other characters.

``skeleton`` decomposes a text, replaces every character by its prototype from the look-alike table, drops what is
invisible and decomposes again; texts that look the same have equal skeletons. The table is the whole public one
(about 6,000 entries), read from the Unicode library that comes with Spark; where that cannot be reached, the letters
written down here are used. ``consistent`` gives the ordinary spelling.

``stand_ins``: the distinct spellings (runs without white space) of the corpus are grouped by equal skeleton. In each
group the commonest ordinary spelling is the one the others stand for. A spelling that differs from its skeleton's
ordinary form is checked letter by letter (invisible characters, unusual spaces and hyphens, full-width and other
compatibility forms, joined letters, accents apart from their letters, letters of another script inside a word); a
word wholly in look-alikes of another script is a stand-in if the other words of its value are in one script and it is
not, or, where the value tells nothing, if an ordinary spelling of its group is at least ``RATIO`` times as common.
Words wholly in their own script, Greek letters used as symbols, precomposed letters, en dashes, curly quotes, line
breaks, tabs and repeated spaces are ordinary.

``misread`` finds what a reading error made of ordinary characters (0 for o, 1 for l, rn for m, d for cl, vv for w):
words of equal skeleton of which another one is far more common. These are not characters of another kind, so they
are a query of their own.

Null and empty values hold none. Values of any length are read whole. Repeated rows are found once.
"""

from __future__ import annotations

import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.llm.joins import having
from quillmill.session import cut

#: Look-alike letters and their Latin prototypes (fixed values): Cyrillic, Greek, others.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝѵӏ", "ABESIJKMHOPCTYXaesijopcyxdhqwvl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνοικρυχϳ", "ABEZHIKMNOPTYXvoikpuxj", strict=True))
OTHER = dict(zip("ıȷɑɡɩʋοℓօսոհցոզյ", "ijagivolounhgnqj", strict=True))
LETTERS = OTHER | GREEK | CYRILLIC
LATIN_ALIKE = frozenset(CYRILLIC.values())
#: Greek letters that stand in for Latin ones only inside Latin words; alone they are symbols.
TWO_SYMBOLS = set("νικρυχ")
#: Letters of other alphabets, and phonetic ones, that are stand-ins within a word of plain letters.
STRANGE = frozenset("օսոհցոզյɑɡɩʋ")
ASCII_PAIR = regex.compile("[A-Za-z]{2}")
HYPHENS = set("‐‑‒⁃﹣－˗➖﹘")
MINUS = "−"
OVERLAYS = {chr(c) for c in range(0x334, 0x339)}
SPACING_ACCENTS = set("´¨ˆˇ˘˙˚˜˝¸˛ˊˋ")
#: Punctuation stand-ins with their prototypes (fixed values).
POINTS = {"․": ".", "꞉": ":", "∶": ":", "։": ":", "׃": ":", "⁄": "/", "∕": "/", "⧸": "/", "ǃ": "!", "‚": ",", "٫": ",", "∣": "|", "ǀ": "|", "∗": "*", "⁎": "*", "ʼ": "’", "′": "’", "՚": "’"}
IGNORABLE = {"͏", "ᅟ", "ᅠ", "ㅤ", "ﾠ", "឴", "឵", "᠋", "᠌", "᠍", "᠏"} | {chr(c) for c in range(0xFE00, 0xFE10)} | {chr(c) for c in range(0xE0100, 0xE01F0)}
#: Digits and sequences of plain letters that are misread for one letter (fixed values).
SEQUENCES = (("0", "o"), ("1", "l"), ("rn", "m"), ("cl", "d"), ("vv", "w"))
#: A spelling is a stand-in if another one of equal skeleton is at least so many times as common.
RATIO = 4

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
EAST_ASIAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}　-〿＀-￯]")
SCRIPTS = (("latin", regex.compile(r"\p{Latin}")), ("cyrillic", regex.compile(r"\p{Cyrillic}")), ("greek", regex.compile(r"\p{Greek}")))
UNUSUAL_FORMS = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>")


def invisible(ch: str) -> bool:
    """Format characters and others without a glyph; line breaks and tabs are ordinary."""
    return ch in IGNORABLE or (not ch.isprintable() and ud.category(ch) in ("Cf", "Cc") and ch not in "\n\r\t")


def unusual_form(ch: str) -> bool:
    """Full-width, styled and enclosed characters, joined letters, and signs that are canonically another letter."""
    d = ud.decomposition(ch)
    if not d:
        return False
    if d.startswith(UNUSUAL_FORMS):
        return True
    if d.startswith("<compat>"):
        return ud.category(ch) in ("Ll", "Lu", "Lt", "Nl") and ch not in "µſ" or ch == "ſ"
    return " " not in d and not d.startswith("<")


def _prototype(ch: str) -> str:
    if invisible(ch) or ch in OVERLAYS:
        return ""
    if ch in LETTERS:
        return LETTERS[ch]
    if ch in HYPHENS or ch == MINUS:
        return "-"
    if ch in POINTS:
        return POINTS[ch]
    if ud.category(ch) in ("Zs", "Zl", "Zp"):
        return " "
    return ud.normalize("NFKD", ch) if unusual_form(ch) else ch


@lru_cache(maxsize=1)
def _small_table() -> dict[str, str]:
    return LETTERS | {"m": "rn", "0": "O", "1": "l", "I": "l", "|": "l"}


_TABLES: dict[str, dict[str, str]] = {}


def look_alikes(spark: SparkSession | None = None) -> dict[str, str]:
    """Prototype of each character that looks like another one; ideographs and Hangul syllables have none."""
    spark = spark or SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return _small_table()
    if "public" not in _TABLES:
        left_out = ((0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xD800, 0xDFFF), (0x20000, 0x3FFFF))
        chars = [c for i in range(0x20, 0x110000) if not any(a <= i <= b for a, b in left_out) and ud.category(c := chr(i)) not in ("Cn", "Co", "Cs", "Cc")]
        # One call for all characters; line feeds keep them apart.
        found = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(chars)).split("\n")
        if len(found) != len(chars):
            return _small_table()
        _TABLES["public"] = {c: k for c, k in zip(chars, found, strict=True) if k != ud.normalize("NFD", c)}
    return _TABLES["public"]


def skeleton(text: str | None, table: dict[str, str] | None = None) -> str | None:
    """What a text looks like: equal for texts that look the same. Null stays null."""
    if text is None:
        return None
    get = (_small_table() if table is None else table).get
    # Forms and spaces first, so that a full-width letter gets the prototype of the letter.
    out = ud.normalize("NFD", "".join(map(_prototype, ud.normalize("NFD", text))))
    return ud.normalize("NFD", "".join([get(ch, ch) for ch in out]))


def script_counts(word: str) -> dict[str, int]:
    """Letters by script, for the scripts that share look-alikes."""
    return {name: n for name, p in SCRIPTS if (n := len(p.findall(word)))}


def _word_mixes(word: str) -> bool:
    if any(ch in STRANGE for ch in word) and ASCII_PAIR.search(word):
        return True
    c = script_counts(word)
    if len(c) < 2:
        return False
    if "cyrillic" in c:
        return True
    # Latin and Greek: symbols such as the beta before a name are ordinary, look-alikes are not.
    return any(ch in GREEK or ch in OTHER for ch in word)


#: Bits of the scripts in ``Context``.
BIT = {"latin": 1, "cyrillic": 2, "greek": 4}


def doubtful_scripts(token: str) -> set[str]:
    """Scripts of the words in a token that are made wholly of look-alikes from another script."""
    out = set()
    for w in WORD.findall(token):
        c = script_counts(w)
        if len(c) != 1:
            continue
        (script,) = c
        if script == "greek" and len(w) == 1 and (w not in GREEK or w in TWO_SYMBOLS):
            continue
        letters = [ch for ch in w if ch.isalpha()]
        table = GREEK if script == "greek" else CYRILLIC if script == "cyrillic" else None
        if all(ch in table for ch in letters) if table is not None else len(letters) <= 2 and all(ch in LATIN_ALIKE for ch in letters):
            out.add(script)
    return out


def foreign(doubtful: set[str], context: int) -> bool:
    """Whether a doubtful word is foreign to its value; ``context``: eight times the bit of the value's main script, plus the bits of all its sure scripts."""
    main, known = context >> 3, context & 7
    # Foreign words may stand in a title of another script, so only clear cases count.
    return main > 0 and any(BIT[s] != main and not known & BIT[s] and not (s == "latin" and main != BIT["cyrillic"]) for s in doubtful)


def context_of(value: Column) -> Column:
    """The context of a value's words: which scripts its sure words are in. 0 without Greek and Cyrillic letters."""
    words = F.regexp_extract_all(value, F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0))
    only = lambda w, script: w.rlike(rf"\p{{Is{script}}}") & ~w.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in ("Latin", "Cyrillic", "Greek") if s != script) + "]")
    sure = {
        "latin": lambda w: only(w, "Latin") & (w.rlike(r"(\p{L}\P{L}*){3}") | w.rlike(rf"[\p{{L}}&&[^{''.join(sorted(LATIN_ALIKE))}]]")),
        "cyrillic": lambda w: only(w, "Cyrillic") & w.rlike(rf"[\p{{L}}&&[^{''.join(CYRILLIC)}]]"),
        "greek": lambda w: only(w, "Greek") & w.rlike(rf"[\p{{L}}&&[^{''.join(GREEK)}]]") & (F.length(w) > 1),
    }
    n = {s: F.size(F.filter(words, f)) for s, f in sure.items()}
    most = F.greatest(*n.values())
    main = F.when(most == 0, 0)
    known = F.lit(0)
    for s, b in BIT.items():
        main = main.when(n[s] == most, b)
        known = known + F.when(n[s] > 0, b).otherwise(0)
    return F.when(value.rlike(r"[\p{IsGreek}\p{IsCyrillic}]"), main * 8 + known).otherwise(F.lit(0)).cast("int")


def holds_stand_in(text: str | None) -> bool:
    """The letter-by-letter check of a spelling; words wholly of look-alikes need their context besides."""
    if not text or text.isascii():
        return bool(text) and any(invisible(ch) for ch in text)
    odd = {ch for ch in text if ord(ch) > 126 or ch < " "}
    for ch in odd:
        if invisible(ch) or ch in HYPHENS:
            if ch == "－" and _beside_east_asian(text, ch):
                continue
            return True
        cat = ud.category(ch)
        if cat in ("Zs", "Zl", "Zp") and not (ch == "　" and _beside_east_asian(text, ch)):
            return True
        if cat[0] != "L" and "＀" <= ch <= "￯" and _beside_east_asian(text, ch):
            continue
        if cat[0] != "Z" and unusual_form(ch):
            return True
        if ch in POINTS or ch == MINUS:
            if regex.search(rf"(?<=[\p{{L}}\p{{M}}]){regex.escape(ch)}(?=[\p{{L}}])", text) or (ch in "․꞉∶;" and regex.search(rf"(?<=[\p{{L}}]){regex.escape(ch)}(?=\s|$)", text)):
                return True
        if ch in SPACING_ACCENTS and regex.search(rf"(?<=\p{{L}}){regex.escape(ch)}|{regex.escape(ch)}(?=\p{{L}})", text):
            return True
        if ch in OVERLAYS:
            return True
    if ud.normalize("NFC", text) != text:
        return True
    return any(map(_word_mixes, WORD.findall(text)))


def _beside_east_asian(text: str, ch: str) -> bool:
    """Whether each occurrence stands beside East Asian writing, where such forms are ordinary."""
    for m in regex.finditer(regex.escape(ch), text):
        around = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if not any("぀" <= c <= "鿿" or "가" <= c <= "힯" or "、" <= c <= "〿" for c in around):
            return False
    return True


def consistent(text: str | None) -> str | None:
    """The ordinary spelling: no invisible characters, ordinary spaces, hyphens, forms and accents, one script a word."""
    if text is None or text.isascii():
        return None if text is None else "".join(ch for ch in text if not invisible(ch))
    out = []
    for ch in text:
        if invisible(ch) or ch in OVERLAYS:
            continue
        cat = ud.category(ch)
        if ch in HYPHENS:
            out.append("-")
        elif cat in ("Zs", "Zl", "Zp"):
            out.append(" ")
        elif unusual_form(ch):
            out.append(ud.normalize("NFKC", ch))
        else:
            out.append(POINTS.get(ch, ch))
    text = ud.normalize("NFC", "".join(out))

    def sure_letters(t: str) -> Counter:
        return Counter(s for ch in t for s, p in SCRIPTS if p.match(ch) and ch not in LETTERS and not (s == "latin" and ch in LATIN_ALIKE))

    whole: list[Counter] = []

    def one_script(m) -> str:
        w = m.group()
        c = script_counts(w)
        if len(c) < 2:
            return w
        # The script of the letters that have no look-alike decides, in the word or else in the whole text.
        sure = sure_letters(w)
        if not sure:
            if not whole:
                whole.append(sure_letters(text))
            sure = whole[0]
        main = max(c, key=lambda s: (sure[s], s == "latin", c[s]))
        if main == "latin":
            return "".join(LETTERS.get(ch, ch) for ch in w)
        back = {v: k for k, v in (CYRILLIC if main == "cyrillic" else GREEK).items()}
        return "".join(back.get(ch, ch) if SCRIPTS[0][1].match(ch) else ch for ch in w)

    return WORD.sub(one_script, text)


#: Runs of these are what spellings are separated by; other spaces may be stand-ins and are part of the spelling.
APART = r"[ \n\r\t]+"
ODD = r"[^\n\r\t -~]"


def spellings(values: DataFrame) -> DataFrame:
    """``(spelling, context, n)``: the distinct runs without ordinary white space, with their context where letters of other scripts occur."""
    x = values.select(context_of(F.col("value")).alias("context"), F.explode(F.split("value", APART)).alias("spelling"))
    return x.groupBy("spelling", "context").agg(F.count("*").alias("n"))


def spelling_groups(distinct: DataFrame, table: dict[str, str]) -> DataFrame:
    """``(spelling, context, n, skeleton, ordinary, doubtful)``; ``ordinary``: how often the group's commonest ordinary spelling occurs, 0 if there is none.

    Only groups with a spelling that is not plain are kept. A group holds the spellings of one word, so it is small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["spelling", "context", "n", "skeleton", "changed", "plain", "stands", "doubtful"]
        for b in batches:
            skel, changed, plain, stands, doubt = [], [], [], [], []
            for t, context in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = skeleton(t, table)
                d = set() if t.isascii() else doubtful_scripts(t)
                skel.append(k)
                s = holds_stand_in(t) or foreign(d, context)
                # A spelling whose skeleton is itself stands for nothing else.
                changed.append((not t.isascii() or s) and ud.normalize("NFC", k) != t)
                plain.append(not s and not d)
                stands.append(s)
                doubt.append(bool(d) and not context >> 3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(skel, pa.string()), *(pa.array(x, pa.bool_()) for x in (changed, plain, stands, doubt))], names=names)

    seen = cut(distinct.mapInArrow(run, "spelling string, context int, n bigint, skeleton string, changed boolean, plain boolean, stands boolean, doubtful boolean"))
    groups = seen.groupBy("skeleton").agg(F.coalesce(F.max(F.when(F.col("plain"), F.col("n"))), F.lit(0)).alias("ordinary"), F.max("changed").alias("any")).filter("any").drop("any")
    return seen.join(groups, "skeleton")


def stand_ins(values: DataFrame) -> DataFrame:
    """``(field, row_id)`` of every value that holds a stand-in, from ``(field, row_id, value)``."""
    held = values.filter(F.col("value").isNotNull())
    groups = spelling_groups(spellings(held), look_alikes(values.sparkSession))
    # The method's candidates: spellings that are not what they look like; the exact check follows.
    strange = cut(groups.filter("changed AND (stands OR (doubtful AND ordinary >= %d * n))" % RATIO).select("spelling", "context"))
    odd = held.filter(F.col("value").rlike(ODD))
    rows = odd.select("field", "row_id", context_of(F.col("value")).alias("context"), F.explode(F.filter(F.array_distinct(F.split("value", APART)), lambda t: t.rlike(ODD))).alias("spelling"))
    return having(rows, strange, ["spelling", "context"], "row_id").select("field", "row_id").distinct()


def plain_words(value: Column) -> Column:
    """The distinct lower-case words of a value."""
    return F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0)))


def read_alike(word: Column) -> Column:
    """What words that are misread for each other have in common."""
    for a, b in SEQUENCES:
        word = F.replace(word, F.lit(a), F.lit(b))
    return word


def misread(values: DataFrame) -> DataFrame:
    """``(field, row_id)`` of every value with a word that a reading error made of ordinary characters."""
    held = values.filter(F.col("value").isNotNull())
    words = held.select("field", "row_id", F.explode(plain_words(F.col("value"))).alias("word"))
    counted = cut(words.groupBy("word").agg(F.count("*").alias("n")).withColumn("skeleton", read_alike(F.col("word"))))
    # A group's spellings differ in a few letters, so a group is small; the plain spelling is the commonest without digits.
    top = counted.groupBy("skeleton").agg(F.max(F.when(~F.col("word").rlike("[0-9]"), F.col("n"))).alias("common"), F.count("*").alias("k")).filter("k > 1 AND common IS NOT NULL")
    digits = F.col("word").rlike("[0-9]")
    rare = F.when(digits, F.col("common") >= F.col("n")).otherwise(F.col("common") >= RATIO * F.col("n"))
    # Digits inside longer words need no second spelling.
    alone = F.col("word").rlike(r"^[^0-9]*\p{L}[01]+\p{L}[^0-9]*$|^[01]\p{L}{3,}$|^\p{L}{3,}[01]$|\p{L}[01]+\p{L}+[01]+\p{L}|\p{L}{2}[01]+\p{L}{2}")
    wrong = cut(counted.join(top, "skeleton", "left").filter(alone | F.coalesce(rare, F.lit(False))).select("word"))
    moved = words.filter(F.col("word").rlike("rn|m|d|cl|vv|w|[01]"))
    return having(moved, wrong, ["word"], "row_id").select("field", "row_id").distinct()


def title_values(source_refs: DataFrame, extracted_refs: DataFrame) -> DataFrame:
    """``(field, row_id, value)`` of the three fields."""
    return (
        source_refs.select(F.lit("source_title").alias("field"), F.col("ref_id").cast("long").alias("row_id"), F.col("title").alias("value"))
        .unionByName(extracted_refs.select(F.lit("extracted_title").alias("field"), F.col("ext_id").cast("long").alias("row_id"), F.col("title").alias("value")))
        .unionByName(extracted_refs.select(F.lit("extracted_surname").alias("field"), F.col("ext_id").cast("long").alias("row_id"), F.col("surname").alias("value")))
    )


def consistent_forms(values: DataFrame) -> DataFrame:
    """``(field, row_id, form, skeleton)`` of every value, null included."""
    table = look_alikes(values.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(consistent, v), pa.string()), pa.array([skeleton(x, table) for x in v], pa.string())], ["field", "row_id", "form", "skeleton"])

    return values.mapInArrow(run, "field string, row_id bigint, form string, skeleton string")
