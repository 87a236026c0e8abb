"""Text normalizers, word extraction and term predicates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_tables() -> tuple[str, str]:
    """Latin letters that decompose to one ASCII letter plus marks, then the marks themselves."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        bare = "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))
        if bare != ch and len(bare) == 1 and bare.isascii():
            src.append(ch)
            dst.append(bare)
    marks = "".join(chr(cp) for cp in range(0x300, 0x370))
    return "".join(src) + marks, "".join(dst)


_ACCENTED, _PLAIN = _fold_tables()


def fold(c: Column) -> Column:
    """Strip accents. ``translate`` deletes source characters that have no counterpart (the marks)."""
    return F.translate(F.coalesce(c, F.lit("")), _ACCENTED, _PLAIN)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_strict(c: Column) -> Column:
    """Lower case, no accents, only ``[a-z0-9 ]``; punctuation is deleted."""
    return F.trim(F.regexp_replace(fold(F.lower(c)), "[^a-z0-9 ]", ""))


def normalize_upper(c: Column) -> Column:
    """Upper case, no accents, single spaces."""
    return squeeze(fold(F.upper(c)))


def normalize_spaced(c: Column) -> Column:
    """Upper case, no accents; punctuation becomes a space."""
    return squeeze(F.regexp_replace(fold(F.upper(c)), r"[^A-Z0-9\s]", " "))


def normalize_compact(c: Column) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(fold(F.lower(c)), "[^a-z0-9]", "")


def normalize_soft(c: Column) -> Column:
    """Lower case, no accents, without ``. , ; :``, single spaces."""
    return squeeze(F.regexp_replace(fold(F.lower(c)), "[.,;:]", ""))


def clean_benefit_name(c: Column) -> Column:
    """Upper case benefit name without footnote markers and punctuation."""
    bare = F.regexp_replace(F.upper(c), r"\(\d+\)", "")
    return squeeze(F.regexp_replace(bare, r"[^A-Z0-9_À-ÿ\s]", ""))


def clean_code(c: Column) -> Column:
    """Keep the digits and dashes of a billing code."""
    return F.regexp_replace(F.trim(c), "[^0-9-]", "")


def bare_code(c: Column) -> Column:
    """Billing code without dots, dashes and blanks."""
    return F.trim(F.regexp_replace(c, r"[.\-\s]", ""))


def any_of(words: list[str]) -> str:
    """Regular expression that matches when any of the words is contained."""
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def contains_any(c: Column, words: list[str]) -> Column:
    return F.coalesce(c.rlike(any_of(words)), F.lit(False))


def has_term(text: Column, term: str) -> Column:
    """Terms of up to three letters match as whole words, longer ones anywhere."""
    if len(term) <= 3:
        return text.rlike(rf"\b{re.escape(term)}\b")
    return text.contains(term)


def significant_words(c: Column, stopwords: list[str]) -> Column:
    """Distinct words of four letters or more that are not stopwords, plus the text itself when it is a short phrase."""
    words = F.filter(F.split(fold(F.lower(c)), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    kept = F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in stopwords]))
    phrase = F.trim(F.lower(c))
    short = (F.length(phrase) > 5) & (F.length(phrase) < 50)
    return F.when(short, F.array_union(kept, F.array(phrase))).otherwise(kept)


def exception_providers(c: Column) -> Column:
    """Providers named after "excepto" or "salvo"; null when the text has no exception."""
    tail = F.split(c, "(?i)excepto|salvo", 3).getItem(1)
    parts = F.transform(
        F.split(tail, r",|y\s"),
        lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p), r"(?i)^(.*?)en\s+", "$1"), r"^\d+%", "")),
    )
    return F.when(c.rlike("(?i)excepto|salvo"), F.filter(parts, lambda p: F.length(p) > 3))


# Byte pairs left when UTF-8 text was read as Latin-1, and the letters they stand for.
MOJIBAKE = [
    ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"), ("Ã¼", "ü"),
    ("Ã\u0081", "Á"), ("Ã\u0089", "É"), ("Ã\u008d", "Í"), ("Ã\u0093", "Ó"), ("Ã\u009a", "Ú"), ("Ã\u0091", "Ñ"),
    ("Â°", "°"), ("Âº", "º"), ("Âª", "ª"), ("Â¿", "¿"), ("Â¡", "¡"),
]


def repair_mojibake(c: Column) -> Column:
    out = c
    for bad, good in MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0))
