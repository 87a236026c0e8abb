"""Parsers for caps, percentages and units written in contract cells. Each returns a struct Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.functions.rules import first_match, search
from saldo.functions.text import squeeze

NUM = r"(\d+(?:[.,]\d+)?)"


def decimal(c: Column, pattern: str, group: int = 1) -> Column:
    """First captured number with comma or dot as decimal mark; null without a match."""
    found = F.regexp_extract(c, pattern, group)
    return F.translate(found, ",", ".").try_cast("double")


def canonical_unit_text(c: Column) -> Column:
    """Upper case with the spellings V.A, V A and VAM written as VA."""
    up = F.upper(F.coalesce(c, F.lit("")))
    va = F.regexp_replace(up, r"\bV\s*\.?\s*A\b\.?", " VA ")
    return squeeze(F.regexp_replace(va, r"\bVAM\b", " VA "))


def canonical_unit(c: Column) -> Column:
    up = F.trim(F.upper(c))
    return first_match(
        [(F.lit(None).cast("string"), c.isNull() | (F.trim(c) == "")), ("VA", up.isin("VAM", "V.A", "V A", "V.A.", "VA")),
         ("SIN_TOPE", up.contains("SIN") & up.contains("TOPE"))],
        up,
    )


def strict_cap(c: Column) -> Column:
    """struct(kind, unit, value, reason). An empty cell is not "no cap"."""
    s = squeeze(F.coalesce(c, F.lit("")))
    up = canonical_unit_text(s)
    empty = s.isin("", "-", "—", "–", "N/A")
    free = up.rlike(r"SIN\s*TOPE|ILIMITADO|SIN\s*L[IÍ]MITE")
    num = decimal(up, NUM)
    kind = first_match([("NO_ENCONTRADO", empty), ("SIN_TOPE_EXPLICITO", free), ("NO_ENCONTRADO", num.isNull())], "NUMERICO")
    unit = F.when(kind == "NUMERICO", first_match([("UF", up.rlike(r"\bUF\b")), ("VA", up.rlike(r"\bVA\b"))], None))
    reason = first_match(
        [("CELDA_VACIA_OCR", empty), ("SIN_TOPE_EXPRESO_EN_CONTRATO", free), ("FORMATO_NO_RECONOCIDO", num.isNull()),
         ("UNIDAD_NO_DETECTADA", unit.isNull())], None)
    return F.struct(kind.alias("kind"), unit.alias("unit"),
                    F.when(kind == "NUMERICO", num).alias("value"), reason.alias("reason"))


def ceiling_factor(c: Column) -> Column:
    """struct(factor, unit): multiples, percentages of the fee schedule or an amount. UF stays literal."""
    s = F.trim(F.translate(F.upper(F.coalesce(c, F.lit(""))), ",", "."))
    times = r"([\d.]+)\s*(?:VECES|X|\*)?\s*(?:AC2|ARANCEL|VAM|BASE)"
    unit = F.when(s.contains("VAM"), "VAM").otherwise("AC2")
    none = s.isin("", "-", "---") | s.rlike(r"\bUF\b|UNIDAD\s+DE\s+FOMENTO")
    by_times = decimal(s, times)
    by_pct = F.when(s.rlike("ARANCEL|AC2|VAM"), decimal(s, r"([\d.]+)%") / 100)
    by_amount = decimal(s, r"\$\s*([\d.]+)")
    return F.struct(
        F.when(none, F.lit(0.0)).otherwise(F.coalesce(by_times, by_pct, by_amount, F.lit(0.0))).alias("factor"),
        first_match([("UNKNOWN", none), (unit, by_times.isNotNull() | by_pct.isNotNull()), ("PESOS", by_amount.isNotNull())],
                    "UNKNOWN").alias("unit"),
    )


def cell_atom(c: Column) -> Column:
    """struct(value, unit, confidence) of a whole cell."""
    t = F.trim(F.coalesce(c, F.lit("")))
    n = decimal(t, f"^{NUM}")
    unit = first_match(
        [("NONE", search(t, r"^sin\s*tope$")), ("EXCLUSION", search(t, r"^solo\s+cobertura\s+libre\s+elecci[oó]n$")),
         ("UF", search(t, rf"^{NUM}\s*UF$")), ("VAM", search(t, rf"^{NUM}\s*VAM$")), ("V.A.", search(t, rf"^{NUM}\s*V\.?A\.?$")),
         ("AC2", search(t, rf"^{NUM}\s*AC2$")), ("%", search(t, rf"^{NUM}\s*%$"))], "UNKNOWN")
    numeric = unit.isin("UF", "VAM", "V.A.", "AC2", "%")
    return F.struct(F.when(numeric, n).alias("value"), unit.alias("unit"),
                    F.when(unit == "UNKNOWN", 0.0).otherwise(1.0).alias("confidence"))


def ac2_multiple(c: Column) -> Column:
    return decimal(c, rf"(?i){NUM}\s*veces\s*AC2")


def line_cap(c: Column) -> Column:
    """struct(kind, factor) of the cap text of a contract line."""
    up, factor = F.upper(c), ac2_multiple(c)
    kind = first_match([("SIN_TOPE", c.isNull() | (c == "") | up.contains("SIN TOPE")), ("UF", up.contains("UF")),
                        ("AC2", factor.isNotNull())], "VARIABLE")
    return F.struct(kind.alias("kind"), F.when(kind == "AC2", factor).alias("factor"))


def cap_clauses(c: Column) -> Column:
    """One struct(scope, kind, factor, unit, exception_pct) per clause of a cap joined by " / "."""

    def clause(p: Column) -> Column:
        up = F.upper(p)
        bare = F.regexp_replace(up, r"\d+%", "")
        free = up.rlike("SIN TOPE|ILIMITADO|SIN LIMITE")
        mixed = up.contains("UF") & up.contains("VAM")
        unit = first_match([("MIXTO", mixed), ("SIN_TOPE", free), ("UF", up.contains("UF")), ("VAM", up.contains("VAM")),
                            ("AC2", up.rlike("AC2|ARANCEL")), ("PESOS", up.rlike(r"\$|PESOS"))], "UNKNOWN")
        return F.struct(
            F.when(up.contains("INTERNAC"), "INTERNACIONAL").otherwise("NACIONAL").alias("scope"),
            F.when(up.contains("ANUAL"), "TOPE_ANUAL").otherwise("TOPE_EVENTO").alias("kind"),
            F.when(~unit.isin("MIXTO", "SIN_TOPE"), decimal(bare, NUM)).alias("factor"),
            unit.alias("unit"),
            F.when(up.contains("EXCEPTO"),
                   F.coalesce(F.regexp_extract(up, r"EXCEPTO.*?(\d+)%", 1).try_cast("int"), F.lit(0))).alias("exception_pct"),
        )

    return F.transform(F.split(F.coalesce(c, F.lit("")), r"\s/\s"), clause)


# Cell texts that mean "not covered".
EXCLUDED_CELLS = ["EXCLUIDO", "SIN COBERTURA", "NO CUBRE", "NO BONIFICA", "SIN BONIFICACION", "NC", "S/C"]


def percent_cell(c: Column) -> Column:
    """Coverage percent of a cell; excluded cells are 0, a lone number up to 100 counts as a percent."""
    up = F.upper(c)
    excluded = F.trim(c).isin("-", "—")
    for word in EXCLUDED_CELLS:
        excluded = excluded | up.contains(word)
    dotted = F.translate(c, ",", ".")
    marked = F.regexp_extract(dotted, r"(\d+)\s*%", 1).try_cast("double")
    lone = F.regexp_extract(dotted, r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    usable = (lone > 1) & (lone <= 100) & ~dotted.contains("UF") & ~dotted.contains("AC2")
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(excluded, 0.0).otherwise(F.coalesce(marked, F.when(usable, lone)))


def financial_term(c: Column) -> Column:
    """struct(state, amount, unit) of a cap cell: EMPTY, SIN_TOPE, NUMERIC or UNKNOWN."""
    s = squeeze(F.coalesce(c, F.lit("")))
    up = F.upper(s)
    unit = first_match(
        [("SIN_TOPE", up.contains("SIN TOPE")), ("UF", up.rlike(r"\bUF\b")), ("VAM", up.rlike(r"\bVAM\b")),
         ("VA", up.rlike(r"\bVA\b")), ("AC2", up.rlike(r"\bAC2\b")),
         ("CLP", up.rlike(r"\bCLP\b") | up.contains("$") | up.contains("PESO"))], None)
    amount = decimal(s, NUM)
    state = first_match([("EMPTY", s == ""), ("SIN_TOPE", up.contains("SIN TOPE")), ("NUMERIC", amount.isNotNull())], "UNKNOWN")
    return F.struct(state.alias("state"), F.when(state == "NUMERIC", amount).alias("amount"), unit.alias("unit"))


def between(x: Column, lo: Column, hi: Column, eps: float = 0.01) -> Column:
    """Point in interval with tolerance."""
    return (x >= lo - eps) & (x <= hi + eps)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Open interval overlap."""
    return (a0 < b1) & (a1 > b0)
