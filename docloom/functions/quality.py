"""Column functions that score texts: letters, scripts, OCR noise, language labels, hash vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import THAI, bound, strip_ascii


def _size(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


def text_quality(text: Column) -> Column:
    """Letters and digits among the characters that are no white space; blank texts have 0."""
    return _size(text, "[^\\p{L}\\p{Nd}²³¹]") / F.greatest(F.lit(1), _size(text, "\\s"))


def ocr_quality(text: Column) -> Column:
    """One less the share of characters that neither words, blanks nor plain punctuation use."""
    weird = _size(text, "[\\p{L}\\p{N}_ก-ฮะ-์\\s.,;:!?()\\[\\]/\\-]+")
    return F.when(~text.rlike("\\S"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - weird / F.length(text)))


def script_counts(text: Column) -> tuple[Column, Column]:
    # what is left without the others: a count by pattern makes an array of all that it finds
    return _size(text, f"[^{THAI}]+"), _size(text, "[^A-Za-z]+")


def script_ratios(text: Column) -> tuple[Column, Column]:
    thai, latin = script_counts(text)
    both = F.greatest(thai + latin, F.lit(1))
    return thai / both, latin / both


def ocr_language(text: Column, default: str = "tha", threshold: float = 0.15) -> Column:
    return F.when(script_ratios(text)[1] >= threshold, "tha+eng").otherwise(default)


def language_label(text: Column) -> Column:
    """By the ratios of ``script_ratios``; without a Thai letter one Latin letter decides."""
    thai, latin = script_counts(text)

    def label(n: Column) -> Column:
        both = F.greatest(n["thai"] + n["latin"], F.lit(1))
        thai, latin = n["thai"] / both, n["latin"] / both
        return F.when(thai >= 0.8, "th").when(latin >= 0.8, "en").when((thai >= 0.4) & (latin >= 0.2), "mixed").otherwise("unknown")

    mixed = lambda thai: bound(F.struct(thai.alias("thai"), latin.alias("latin")), label)
    alone = F.when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")
    return bound(thai, lambda thai: F.when(thai == 0, alone).otherwise(mixed(thai)))


def mostly_thai(text: Column, threshold: float = 0.5) -> Column:
    return F.coalesce(script_counts(text)[0] / F.nullif(F.length(text), F.lit(0)) >= threshold, F.lit(False))


def needs_ocr(text: Column, min_length: int = 50, min_score: float = 0.2) -> Column:
    return (F.length(F.regexp_replace(text, "^\\s+|\\s+$", "")) < min_length) | (text_quality(text) < min_score)


def valid_ocr(text: Column, lang: Column, min_score: float = 0.7, min_length: int = 30) -> Column:
    return (F.length(strip_ascii(text)) >= min_length) & lang.isin("th", "en") & (ocr_quality(text) >= min_score)


def hash_vector(text: Column, dim: int = 32) -> Column:
    """A vector from the first ``dim`` bytes, repeated cyclically; the empty text counts as "0"."""
    # the first ``dim`` characters hold the first ``dim`` bytes
    raw = F.hex(F.substring(F.encode(F.when(text == "", "0").otherwise(F.left(text, F.lit(dim))), "UTF-8"), 1, dim))
    byte = lambda i: F.conv(F.substr(raw, (i % (F.length(raw) / 2).cast("int")) * 2 + 1, F.lit(2)), 16, 10).cast("long")
    terms = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: byte(i) * (i + 1))
    sums = F.aggregate(terms, F.array().cast("array<bigint>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0).cast("long")) + x)))
    return F.transform(sums, lambda x: (x % 9973) / 9973)
