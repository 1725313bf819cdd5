"""Column functions on text: normalisation, splitting, headings, names, redaction, token estimates."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from unicodedata import normalize

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, patterns and words that results depend on.
THAI = "฀-๿"
HEADING = "|".join([r"^บท\s*ที่\s*\d+", r"^หมวด\s*ที่?\s*\d+", r"^ภาคผนวก", r"^บท\s*\d+", r"^(?:\d+\.)+\s+", r"^\d+\)\s+", r"^[A-Za-zก-๙]+\s*:\s+"])
BULLET = "|".join([r"^[\-•–]\s+", r"^[ก-ฮ]\)\s+", r"^\([ก-ฮ]\)\s+", r"^\([0-9]+\)\s+"])
BULLET_LINE = r"^([\-•–*]|\d+[.)]|[ก-ฮ]\)|\([0-9]+\)|\([ก-ฮ]\))\s+"
#: White space as Python's str.strip and \\s know it.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: All characters that NFC changes, reorders or composes with another lie in these ranges; general punctuation does not.
COMPOSING = "[\\x{300}-\\x{2001}\\x{20D0}-\\x{10FFFF}]"
#: Texts without control characters, blanks but spaces and line feeds, Thai letters and what NFC changes. A run over the
#: whole text takes a tenth of the time of a search for another character.
PLAIN = "\\A[\n\\x20-\\x7E\\x{A1}-\\x{2FF}]*+\\z"
SENTENCE_END = ".!?…ฯ๛ๆ"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[- .]?)?(?:\d{2,4}[- .]?){2,4}\d{2,4}(?!\d)"
NATIONAL_ID = r"\b\d{13}\b"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)``, where ``x`` is made once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def nfc(text: Column) -> Column:
    """NFC; an Arrow UDF, for Spark has no such function. Only texts with a code point that it can touch go to it."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else normalize("NFC", x))

    return F.coalesce(normal(F.when(text.rlike(COMPOSING), text)), text)


def normalize_text(text: Column, preserve_newlines: bool = True, compose: bool = True) -> Column:
    """Line ends, invisible and control characters, runs of blanks, lines stripped; NFC unless ``compose`` is off."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = nfc(t) if compose else t
    if preserve_newlines:  # most texts have spaces and line feeds only, which needs no patterns
        return bound(t, lambda t: F.when(t.rlike(PLAIN), _plain_lines(t)).otherwise(_lines(t)))
    return strip(F.regexp_replace(_visible(t), f"[{SPACE}]+", " "))


def _visible(t: Column) -> Column:
    for sign, by in (("\u00a0", " "), ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", "")):
        t = F.replace(t, F.lit(sign), F.lit(by))
    return F.regexp_replace(t, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")


def _lines(t: Column) -> Column:
    blank = f"[{SPACE}&&[^\n]]"
    t = F.regexp_replace(F.regexp_replace(_visible(t), "[ \\t]+", " "), f"{blank}*\n{blank}*", "\n")
    return F.regexp_replace(F.btrim(t, F.lit(SPACES.replace("\n", ""))), "\\n{3,}", "\n\n")


def _plain_lines(t: Column) -> Column:
    """As ``_lines``, of a ``PLAIN`` text."""
    t = bound(t, lambda t: F.when(t.contains("  "), F.regexp_replace(t, " {2,}", " ")).otherwise(t))
    t = F.btrim(F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
    return bound(t, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def strip_ascii(text: Column) -> Column:
    """``regexp_replace(text, "^\\\\s+|\\\\s+$", "")``; only texts that end with another line end need the pattern, whose $ is before that."""
    ends = text.endswith("\x85") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(ends, F.regexp_replace(text, "^\\s+|\\s+$", "")).otherwise(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")))


def joined_thai(text: Column) -> Column:
    return F.regexp_replace(text, f"([{THAI}])[{SPACE}]+([{THAI}])", "$1$2")


def tidy_thai(text: Column) -> Column:
    """Drops white space between Thai letters, pair by pair; runs of blanks and tabs become one blank."""
    return F.regexp_replace(joined_thai(text), "[ \\t]+", " ")


def clean_for_index(text: Column, compose: bool = True) -> Column:
    # there are no runs of blanks or of more than two line feeds any more, and neither step makes some
    t = bound(normalize_text(text, compose=compose), lambda t: F.when(t.contains("-\n"), F.regexp_replace(t, "([A-Za-z0-9])-\\n([A-Za-z0-9])", "$1$2")).otherwise(t))
    return strip(bound(t, lambda t: F.when(F.length(t) < F.octet_length(t), joined_thai(t)).otherwise(t)))


def smart_paragraphs(text: Column, longest: int = 1200, packed: int = 600) -> Column:
    """Paragraphs of a text as an array: blocks between blank lines, bullet lines by themselves, and
    paragraphs over ``longest`` characters as sentences packed up to ``packed``; at least two characters each."""
    mark, alone = "\x01", "\x02"  # between paragraphs; before a bullet line
    t = strip(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(mark), F.lit(" ")), F.lit(alone), F.lit(" ")))

    def blocks(t: Column) -> Column:
        return F.regexp_replace(t, f"\n[{SPACE}]*\n+", f"\n{mark}\n")

    t = bound(t, lambda t: F.when(~t.contains(" \n") & t.rlike(PLAIN), blocks(t)).otherwise(F.regexp_replace(blocks(t), f"[{SPACE}&&[^\n]]+\n", "\n")))
    in_line = BULLET_LINE.removesuffix("\\s+") + f"[{SPACE}&&[^\n]]+"  # white space of this line, not the next
    t = F.regexp_replace(t, f"(?m){in_line}[^\n]*", mark + alone + "$0" + mark)
    parts = F.filter(F.transform(F.split(t, f"[{mark}\n]*{mark}[{mark}\n]*"), strip), lambda x: x != "")

    def pack(x: Column) -> Column:  # sentences are stripped and not empty, so that what they are joined to needs no strip
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
        full = lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        some = F.filter(F.transform(sentences(x), strip), lambda y: y != "")
        return F.aggregate(some, start, lambda s, y: F.when(
            F.length(s["now"]) + 1 + F.length(y) > packed, F.struct(full(s).alias("done"), y.alias("now")))
            .otherwise(F.struct(s["done"].alias("done"), F.when(s["now"] == "", y).otherwise(F.concat(s["now"], F.lit(" "), y)).alias("now"))), full)

    cut = F.flatten(F.transform(parts, lambda x: F.when((F.length(x) > longest) & ~x.startswith(alone), pack(x)).otherwise(F.array(F.ltrim(x, F.lit(alone))))))
    return F.filter(cut, lambda x: F.length(x) >= 2)


def strip_markdown(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "```[\\s\\S]*?```", ""), "(?m)^#{1,6}\\s+", "")
    return F.regexp_replace(F.regexp_replace(t, "(?m)^\\s*([\\-*+]\\s+)", ""), "^\\s+|\\s+$", "")


def _at_start(patterns: str) -> str:
    """Patterns that begin with ^ each, with one ^ for all, so that a search ends at once elsewhere."""
    return "^(?:" + "|".join(p.removeprefix("^") for p in patterns.split("|")) + ")"


def is_heading(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+", "").rlike(_at_start(HEADING))


def is_bullet(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+", "").rlike(_at_start(BULLET))


def sentences(text: Column) -> Column:
    return F.split(text, f"\\s(?<=[{SENTENCE_END}]\\s)\\s*")


def document_name(path: Column) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)/*$", 1), "(.)\\.[^.]*$", "$1")
    name = F.regexp_replace(F.regexp_replace(F.lower(stem), f"[^0-9A-Za-z{THAI}]+", "_"), "^_+|_+$", "")
    name = F.when(name == "", "document").otherwise(name)
    return F.when(name.endswith(".txt"), name).otherwise(F.concat(name, F.lit(".txt")))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4.0)).cast("long")


def counted_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4.0)).cast("long")


def redact(text: Column) -> Column:
    """E-mail addresses, then phone numbers, then 13-digit numbers."""
    t = F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")
    return F.regexp_replace(F.regexp_replace(t, PHONE, "[REDACTED_PHONE]"), NATIONAL_ID, "[REDACTED_ID]")


def index_tokens(text: Column) -> Column:
    """Lower-cased white-space tokens, in order."""
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")


@cache
def _folds() -> tuple[str, str]:
    """Letters that decompose into a letter and marks, and those letters; the marks themselves come last and go."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    folded = {"ς": "σ"}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))):
        base, *rest = normalize("NFD", c)
        if rest and base not in marks and all(x in marks for x in rest):
            folded[c] = base
    return "".join([*folded, *marks]), "".join(folded.values())


def folded(text: Column) -> Column:
    """Lower-cased, without the marks on letters."""
    low = F.lower(text)
    return F.when(low.rlike("[^\\x00-\\x7F]"), F.translate(low, *_folds())).otherwise(low)


def folded_terms(text: Column) -> Column:
    """The folded runs of letters, digits and private characters, in order; all other marks break them."""
    return F.filter(F.split(folded(text), "[^\\p{L}\\p{N}\\p{Co}]+"), lambda w: w != "")


def chunk_id(path: Column, page: Column, index: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, page.cast("string"), index.cast("string"))), 1, 32)


#: Fixed value: the name space of URLs for name-based ids.
URL_NAMES = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def name_uuid(name: Column, names: str = URL_NAMES) -> Column:
    """The name-based id of version 5: SHA-1 over name space and name, with version and variant put in."""
    h = F.sha1(F.concat(F.unhex(F.lit(names.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def page_number(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def sanitized_query(text: Column) -> Column:
    """A question without the characters that have a meaning in match expressions; quotes are doubled."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), "[/()\\-:*?\\[\\]{}]", " ")


def citation(source: Column, path: Column, page: Column) -> Column:
    """``source:page``; the path stands in for a missing source, and a missing page is left out."""
    name = F.coalesce(F.nullif(source, F.lit("")), F.nullif(path, F.lit("")), F.lit("unknown"))
    return F.concat(name, F.coalesce(F.concat(F.lit(":"), page.cast("string")), F.lit("")))
