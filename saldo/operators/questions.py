"""Named questions over bills and settlements, answered for every account at once.

Answers are whole; a ``limit`` shows only the first rows of each group where the caller sets one. Totals and
counts always cover everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import largest_amount, primary_charge, total
from saldo.functions.text import any_of, fold, has_term
from saldo.operators import sequence


def _plain(c: str) -> Column:
    return fold(F.lower(F.col(c)))


def _any_term(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | has_term(c, t)
    return out


def page_coverage(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows and items per page, pages without items, amounts among the rows, and the estimated missing items."""
    priced = ~F.col("kind").isin("header", "footer") & (largest_amount(F.col("text")) > 0)
    r = rows.groupBy("account", "page").agg(F.count(F.lit(1)).alias("rows"), F.count_if(priced).alias("priced"))
    i = items.groupBy("account", "page").agg(F.count(F.lit(1)).alias("items"))
    zero = F.lit(0)
    j = r.join(i, ["account", "page"], "full")
    n, p = F.coalesce("items", zero), F.coalesce("priced", zero)
    return j.select("account", "page", F.coalesce("rows", zero).alias("rows"), n.alias("items"), p.alias("priced"),
                    F.greatest(zero, p - n).alias("missing"), (F.col("rows").isNotNull() & F.col("items").isNull()).alias("uncovered"))


def row_kinds(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


def page_detail(rows: DataFrame, page: int) -> DataFrame:
    """All printed rows of one page."""
    return rows.filter((F.col("page") == page) & (F.length(F.trim("text")) > 0)).select("account", "row_no", "kind", F.trim("text").alias("text"))


def line_by_line(rows: DataFrame) -> DataFrame:
    """Every printed row, numbered within its page."""
    shown = rows.filter((F.col("page") > 0) & (F.trim("text") != ""))
    n = sequence.number(shown, ["account", "page"], ["row_no", "text"], sequence.by_pos("row_no"), name="n")
    return n.select("account", "page", "n", F.trim("text").alias("text"))


def list_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of each account by page and description."""
    order = ["page", "description", "part", "provider", "total", "qty", "folio", "ts"]
    return sequence.ranked(items, ["account"], order, F.col("page").cast("long"), limit).select("account", "n", "page", "description", "total")


def where_and_how_much(items: DataFrame, rows: DataFrame, terms: list[str]) -> DataFrame:
    """Matches of a clinical term and their amount: item totals, row charges when those are clearly larger, else row amounts."""
    i = items.filter(_any_term(_plain("description"), terms)).groupBy("account").agg(
        F.count(F.lit(1)).alias("items"), F.sum("total").alias("from_items"))
    r = rows.withColumn("plain", _plain("text")).filter(_any_term(F.col("plain"), terms)).withColumn("charge", primary_charge(F.col("text")))
    by_row = r.groupBy("account").agg(F.count(F.lit(1)).alias("rows"), F.sum(largest_amount(F.col("text"))).alias("from_rows"),
                                      F.bool_or(F.col("kind") == "item_primary").alias("_primary"))
    once = r.filter("charge > 0").groupBy("account", "page", "charge", "plain").agg(
        F.bool_or(F.col("kind") == "item_primary").alias("_p"))
    charges = once.groupBy("account").agg(F.sum("charge").alias("_all"), F.sum(F.when(F.col("_p"), F.col("charge"))).alias("_main"))
    zero = F.lit(0)
    j = by_row.join(charges, "account", "left").join(i, "account", "full")
    c = j.select("account", F.coalesce("items", zero).alias("items"), F.coalesce("rows", zero).alias("rows"), F.coalesce("from_items", zero).alias("from_items"),
                 F.coalesce("from_rows", zero).alias("from_rows"),
                 F.coalesce(F.when(F.col("_primary"), F.col("_main")).otherwise(F.col("_all")), zero).alias("from_charges"))
    use_charges = (F.col("from_charges") > 0) & ((F.col("from_items") == 0) | (F.col("from_charges") > F.col("from_items") * 1.4))
    amount = F.when(use_charges, F.col("from_charges")).when(F.col("from_items") == 0, F.col("from_rows")).otherwise(F.col("from_items"))
    return c.select("account", "items", "rows", amount.alias("amount"))


def term_pages(items: DataFrame, terms: list[str]) -> DataFrame:
    return items.filter(_any_term(_plain("description"), terms)).select("account", "page").distinct()


def find_product(items: DataFrame, term: str) -> DataFrame:
    """Items whose text contains a term: counts and amount per account."""
    return items.filter(_plain("description").contains(term)).groupBy("account").agg(F.count(F.lit(1)).alias("items"), F.sum("total").alias("amount"))


def first_matches(items: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    hits = items.filter(_plain("description").contains(term))
    order = ["page", "part", "provider", "total", "qty", "folio", "ts"]
    return sequence.ranked(hits, ["account"], order, F.col("page").cast("long"), limit).select("account", "n", "page", "description", "total")


# Words of surgery charges.
SURGERY_WORDS = ["pabellon", "pbellon", "quirofano", "cirugia"]


def surgery_total(items: DataFrame) -> DataFrame:
    hits = items.filter(_plain("description").rlike(any_of(SURGERY_WORDS)))
    return hits.groupBy("account").agg(F.count(F.lit(1)).alias("items"), F.sum("total").alias("amount"))


def items_with_page_subtotal(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of each page beside the subtotal of the whole page."""
    usable = items.filter("page > 0 and total > 0")
    sub = usable.groupBy("account", "page").agg(F.sum("total").alias("subtotal"))
    order = ["part", "provider", "total", "qty", "folio", "ts"]
    top = sequence.ranked(usable, ["account", "page"], order, sequence.by_pos("part"), limit)
    return top.join(sub, ["account", "page"]).select("account", "page", "n", "part", "total", "subtotal")


def page_count_and_totals(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages, items, item total, printed footer total and the total to show (the footer where there is one)."""
    i = items.groupBy("account").agg(F.count(F.lit(1)).alias("items"), F.sum("total").alias("grand_total"))
    footer = F.when(F.trim("text").rlike(r"(?i)^total\s+empresa\b"), primary_charge(F.col("text")))
    per_page = rows.groupBy("account", "page").agg(F.max_by(footer, F.when(footer > 0, F.struct("row_no", "text"))).alias("f"))
    r = per_page.groupBy("account").agg(F.count_if(F.col("page") > 0).alias("pages"), total(F.col("f")).alias("footer_total"))
    shown = F.coalesce(F.nullif("footer_total", F.lit(0)), F.col("grand_total"))
    return r.join(i, "account").select("account", "pages", "items", "grand_total", "footer_total", shown.alias("shown"))


def detected_total(lines: DataFrame, key: str) -> DataFrame:
    """Total of a text: the sum of the largest amount of every "total empresa" line, else the largest of a global total line."""
    t = F.col("text")
    amount = largest_amount(t)
    company = F.when(t.rlike(r"(?i)total\s+empresa") & (amount > 1000), amount)
    global_ = F.when(t.rlike(r"(?i)grand[_\s]?total|total\s+cuenta|monto\s+total|total\s+final|saldo\s+cuenta") & (amount > 0), amount)
    g = lines.groupBy(key).agg(F.sum(company).alias("c"), F.max(global_).alias("g"))
    return g.select(key, F.coalesce("c", "g", F.lit(0)).alias("total"),
                    F.when(F.col("c").isNotNull(), "total_empresa_sum").when(F.col("g").isNotNull(), "global_line_max").otherwise("none").alias("source"))


def folio_list(lines: DataFrame, declared: DataFrame) -> DataFrame:
    g = lines.groupBy("account", "folio").agg(F.count_distinct("provider").alias("providers"))
    return g.join(declared, ["account", "folio"], "left").select("account", "folio", "providers", "declared_copago")


def one_folio(lines: DataFrame, folio: str) -> DataFrame:
    return lines.filter(F.col("folio") == folio).groupBy("account").agg(
        F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")], F.count_distinct("provider").alias("providers"))


def folio_items(lines: DataFrame, folio: str, limit: int | None = None) -> DataFrame:
    order = ["page", "part", "provider", "valor", "qty", "ts"]
    return sequence.ranked(lines.filter(F.col("folio") == folio), ["account"], order, F.col("page").cast("long"), limit).select("account", "n", "part", "valor", "copago")


def provider_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("provider").agg(F.count(F.lit(1)).alias("items"), *[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")],
                                         F.count_distinct("folio").alias("folios"))


def inconsistent_folios(lines: DataFrame, declared: DataFrame, tolerance: int = 500) -> DataFrame:
    g = lines.groupBy("account", "folio").agg(F.sum("copago").alias("calculated"))
    gap = F.col("calculated") - F.coalesce("declared_copago", F.lit(0))
    return g.join(declared, ["account", "folio"], "left").select("account", "folio", "calculated", "declared_copago", gap.alias("gap")).filter(F.abs("gap") > tolerance)


def search_lines(lines: DataFrame, term: str) -> DataFrame:
    """Lines whose code, text, provider or folio contains a term."""
    blob = fold(F.lower(F.concat_ws(" ", "code", "description", F.col("provider").cast("string"), "folio")))
    return lines.filter(blob.contains(term)).groupBy("account").agg(
        F.count(F.lit(1)).alias("lines"), *[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")], F.count_distinct("folio").alias("folios"))


def settlement_overview(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_distinct("account", "folio").alias("folios"), F.count_distinct("provider").alias("providers"), F.count(F.lit(1)).alias("items"),
                     *[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")])


def page_slices(items: DataFrame, terms: list[str], pages: int | None = None, rows: int | None = None) -> DataFrame:
    """All rows of the pages that mention a term, or of the first ``pages``, each cut after ``rows``."""
    hit = term_pages(items, terms)
    if pages is not None:
        hit = sequence.best(hit, ["account"], [F.col("page")], pages)
    on_page = items.join(hit, ["account", "page"], "left_semi")
    order = ["part", "provider", "total", "qty", "folio", "ts"]
    return sequence.ranked(on_page, ["account", "page"], order, sequence.by_pos("part"), rows).select("account", "page", "n", "description", "total")
