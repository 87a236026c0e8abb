"""Money: parsing, rounding and formatting. Amounts are whole currency units in LongType."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """floor(x + 0.5), also for negatives; null counts as zero."""
    return F.coalesce(F.floor(c + F.lit(0.5)), F.lit(0)).cast("long")


def total(c: Column) -> Column:
    """Sum that is zero, not null, over no rows."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def parse_whole(c: Column) -> Column:
    """Digits and minus signs only, as a whole number; anything unusable is zero."""
    digits = F.regexp_extract(F.regexp_replace(c, "[^0-9-]", ""), r"^(-?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(0)).cast("long")


def parse_decimal_comma(c: Column) -> Column:
    """Dots group thousands, the first comma is the decimal mark."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\.", ""), r"^([^,]*),", "$1.")
    number = F.regexp_extract(plain, r"^\s*(-?[0-9]+(\.[0-9]*)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def parse_mixed(c: Column, quantity: bool = False) -> Column:
    """Either separator may be the decimal mark; parentheses or a leading minus make it negative.

    With both marks the last one is the decimal mark. A single mark followed by three digits groups
    thousands for money, but is a decimal mark for quantities.
    """
    raw = F.trim(F.coalesce(c, F.lit("")))
    bracketed = raw.startswith("(") & raw.endswith(")")
    kept = F.regexp_replace(raw, r"[^\d.,-]", "")
    negative = bracketed | kept.startswith("-")
    body = F.regexp_replace(kept, "^-", "")
    dots, commas = _count(body, "."), _count(body, ",")
    no_dots, no_commas = F.replace(body, F.lit("."), F.lit("")), F.replace(body, F.lit(","), F.lit(""))
    grouped = body.rlike(r"^\d+[.,]\d{3}$") if not quantity else F.lit(False)
    plain = (
        F.when((dots > 0) & (commas > 0),
               F.when(F.locate(",", F.reverse(body)) < F.locate(".", F.reverse(body)),
                      F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(no_commas))
        .when(commas > 1, no_commas)
        .when(dots > 1, no_dots)
        .when(commas + dots == 1, F.when(grouped, F.translate(body, ".,", "")).otherwise(F.translate(body, ",", ".")))
        .otherwise(body)
    )
    value = F.coalesce(plain.try_cast("double"), F.lit(0.0))
    return F.when(negative & (value != 0), -value).otherwise(value)


def format_money(c: Column) -> Column:
    """-$1.234"""
    sign = F.when(c < 0, "-$").otherwise("$")
    return F.concat(sign, F.translate(F.format_number(F.abs(c), 0), ",", "."))


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def ratio(n: Column, d: Column) -> Column:
    """n / d, zero when d is not positive."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def percent_text(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


NUMBER_TOKEN = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d+(?:,\d+)?"


def parse_token(t: Column) -> Column:
    """One token of NUMBER_TOKEN: dots group thousands, a comma is the decimal mark."""
    return F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".").try_cast("double")


def number_tokens(c: Column) -> Column:
    """Positive numbers written in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({NUMBER_TOKEN})"), F.lit(1))
    return F.filter(F.transform(found, parse_token), lambda v: v > 0)


def largest_amount(c: Column) -> Column:
    """Largest number of a line, of any size; zero without any."""
    usable = number_tokens(c)
    return round_half_up(F.array_max(usable))


def primary_charge(c: Column) -> Column:
    """The larger of the last two numbers of a line; zero with fewer than two."""
    usable = number_tokens(c)
    last, prev = F.try_element_at(usable, F.lit(-1)), F.try_element_at(usable, F.lit(-2))
    return F.when(F.size(usable) < 2, F.lit(0)).otherwise(round_half_up(F.greatest(last, prev))).cast("long")


def parse_date(c: Column) -> Column:
    """DD/MM/YYYY or ISO."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy")), F.try_to_timestamp(c))


def unit_value_on(day_value: Column, fallback: float = 39750.0) -> Column:
    """Value of the indexed unit on a day, with the constant used when the day has none."""
    return F.coalesce(day_value, F.lit(float(fallback)))
