"""Questions over bills and settlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, LINES, ROWS, charge, largest
from saldo.catalog.registry import query
from saldo.catalog.reports import DECLARED_LINES, declared_lines
from saldo.operators import questions as Q
from saldo.sources import star

PLAIN = "strip_accents(lower(description))"
TERMS = ["pabellon", "quirofano", "cirugia"]
SHORT = ["kit", "ml", "set"]


def _lines(spark, sf):
    return star.charges(spark, sf).withColumnRenamed("total", "valor")


def _declared(spark, sf):
    return declared_lines(star.settlement_lines(spark, sf)).select("account", "folio", "declared_copago")


@query("q01_page_coverage", f"""WITH {ROWS}, r AS (SELECT account, page, count(*) AS rows, count(*) FILTER (WHERE kind NOT IN ('header', 'footer') AND {largest('text')} > 0) AS priced FROM rws GROUP BY ALL),
  i AS (SELECT account, CASE WHEN folio LIKE 'R%' THEN page + 10 ELSE page END AS page, count(*) AS items FROM described GROUP BY ALL)
  SELECT account, page, coalesce(rows, 0) AS rows, coalesce(items, 0) AS items, coalesce(priced, 0) AS priced, greatest(0, coalesce(priced, 0) - coalesce(items, 0)) AS missing, rows IS NOT NULL AND items IS NULL AS uncovered FROM r FULL JOIN i USING (account, page)""")
def q01(spark, sf):
    return Q.page_coverage(star.bill_rows(spark, sf), star.charges(spark, sf).withColumn("page", F.when(F.col("folio").startswith("R"), F.col("page") + 10).otherwise(F.col("page"))))


@query("q01_row_kinds", f"WITH {ROWS} SELECT kind, count(*) AS rows FROM rws GROUP BY kind")
def q01b(spark, sf):
    return Q.row_kinds(star.bill_rows(spark, sf))


@query("q02_page_detail", f"WITH {ROWS} SELECT account, row_no, kind, text FROM rws WHERE page = 3")
def q02(spark, sf):
    return Q.page_detail(star.bill_rows(spark, sf), 3)


@query("q03_line_by_line", f"WITH {ROWS} SELECT account, page, row_number() OVER (PARTITION BY account, page ORDER BY row_no, text) AS n, text FROM rws")
def q03(spark, sf):
    return Q.line_by_line(star.bill_rows(spark, sf))


@query("q04_list_items", f"WITH {DESCRIBED} SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY page, description, part, provider, total, qty, folio, ts) AS INT) AS n, page, description, total FROM described")
def q04(spark, sf):
    return Q.list_items(star.described(spark, sf))


def _has(c, terms):
    return "(" + " OR ".join(f"regexp_matches({c}, '\\b{t}\\b')" if len(t) <= 3 else f"contains({c}, '{t}')" for t in terms) + ")"


@query("q05_where_and_how_much", f"""WITH {ROWS}, i AS (SELECT account, count(*) AS items, CAST(sum(bonif) AS BIGINT) AS fi FROM described WHERE {_has(PLAIN, TERMS + SHORT)} GROUP BY account),
  r AS (SELECT *, strip_accents(lower(text)) AS plain, {charge('text')} AS charge, {largest('text')} AS big FROM rws WHERE {_has("strip_accents(lower(text))", TERMS + SHORT)}),
  br AS (SELECT account, count(*) AS rows, CAST(sum(big) AS BIGINT) AS fr, bool_or(kind = 'item_primary') AS prim FROM r GROUP BY account),
  d AS (SELECT account, page, charge, plain, bool_or(kind = 'item_primary') AS p FROM r WHERE charge > 0 GROUP BY ALL),
  ch AS (SELECT account, sum(charge) AS a, sum(charge) FILTER (WHERE p) AS m FROM d GROUP BY account),
  j AS (SELECT account, coalesce(items, 0) AS items, coalesce(rows, 0) AS rows, coalesce(fi, 0) AS fi, coalesce(fr, 0) AS fr, CAST(coalesce(CASE WHEN prim THEN m ELSE a END, 0) AS BIGINT) AS fc FROM br LEFT JOIN ch USING (account) FULL JOIN i USING (account))
  SELECT account, items, rows, CASE WHEN fc > 0 AND (fi = 0 OR fc > fi * 1.4) THEN fc WHEN fi = 0 THEN fr ELSE fi END AS amount FROM j""")
def q05(spark, sf):
    items = star.described(spark, sf).withColumn("total", F.col("bonif"))
    return Q.where_and_how_much(items, star.bill_rows(spark, sf), TERMS + SHORT)


@query("q05_term_pages", f"WITH {DESCRIBED} SELECT DISTINCT account, page FROM described WHERE {_has(PLAIN, TERMS)}")
def q05b(spark, sf):
    return Q.term_pages(star.described(spark, sf), TERMS)


@query("q06_find_product", f"WITH {DESCRIBED} SELECT account, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM described WHERE contains({PLAIN}, 'vicryl') GROUP BY account")
def q06(spark, sf):
    return Q.find_product(star.described(spark, sf), "vicryl")


@query("q06_first_matches", f"WITH {DESCRIBED} SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY page, part, provider, total, qty, folio, ts) AS INT) AS n, page, description, total FROM described WHERE contains({PLAIN}, 'vicryl')")
def q06b(spark, sf):
    return Q.first_matches(star.described(spark, sf), "vicryl")


@query("q07_surgery_total", f"WITH {DESCRIBED} SELECT account, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM described WHERE regexp_matches({PLAIN}, 'pabellon|pbellon|quirofano|cirugia') GROUP BY account")
def q07(spark, sf):
    return Q.surgery_total(star.described(spark, sf))


@query("q08_items_with_page_subtotal", f"WITH {CHARGES} SELECT account, page, CAST(row_number() OVER (PARTITION BY account, page ORDER BY part, provider, total, qty, folio, ts) AS INT) AS n, part, total, CAST(sum(total) OVER (PARTITION BY account, page) AS BIGINT) AS subtotal FROM charges WHERE page > 0 AND total > 0")
def q08(spark, sf):
    return Q.items_with_page_subtotal(star.charges(spark, sf))


@query("q09_page_count_and_totals", f"""WITH {ROWS}, i AS (SELECT account, count(*) AS items, CAST(sum(total) AS BIGINT) AS grand_total FROM described GROUP BY account), f AS (SELECT account, page, arg_max({charge('text')}, (row_no, text)) FILTER (WHERE kind = 'footer' AND {charge('text')} > 0) AS f FROM rws GROUP BY ALL),
  r AS (SELECT account, count(*) AS pages, CAST(coalesce(sum(f), 0) AS BIGINT) AS footer_total FROM f GROUP BY account) SELECT account, pages, items, grand_total, footer_total, coalesce(nullif(footer_total, 0), grand_total) AS shown FROM r JOIN i USING (account)""")
def q09(spark, sf):
    return Q.page_count_and_totals(star.charges(spark, sf), star.bill_rows(spark, sf))


@query("f23_detected_total", f"""WITH {ROWS}, t AS (SELECT account, {largest('text')} AS v, kind FROM rws), s AS (SELECT account, sum(v) FILTER (WHERE kind = 'footer' AND v > 1000) AS c FROM t GROUP BY account) SELECT account, CAST(coalesce(c, 0) AS BIGINT) AS total, CASE WHEN c IS NULL THEN 'none' ELSE 'total_empresa_sum' END AS source FROM s""")
def f23(spark, sf):
    return Q.detected_total(star.bill_rows(spark, sf), "account")


@query("q10_folio_list", f"WITH {LINES}, {DECLARED_LINES}, g AS (SELECT account, folio, count(DISTINCT provider) AS providers FROM charges GROUP BY ALL) SELECT account, folio, providers, declared_copago FROM g JOIN dl USING (account, folio)")
def q10(spark, sf):
    return Q.folio_list(_lines(spark, sf), _declared(spark, sf))


@query("q11_one_folio", f"WITH {CHARGES} SELECT account, count(*) AS items, CAST(sum(total) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago, count(DISTINCT provider) AS providers FROM charges WHERE folio = 'NF' GROUP BY account")
def q11(spark, sf):
    return Q.one_folio(_lines(spark, sf), "NF")


@query("q11_folio_items", f"WITH {CHARGES} SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY page, part, provider, total, qty, ts) AS INT) AS n, part, total AS valor, copago FROM charges WHERE folio = 'NF'")
def q11b(spark, sf):
    return Q.folio_items(_lines(spark, sf), "NF")


@query("q12_provider_totals", f"WITH {CHARGES} SELECT provider, count(*) AS items, CAST(sum(total) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago, count(DISTINCT folio) AS folios FROM charges GROUP BY provider")
def q12(spark, sf):
    return Q.provider_totals(_lines(spark, sf))


@query("q13_inconsistent_folios", f"WITH {LINES}, {DECLARED_LINES} SELECT account, folio, copago AS calculated, declared_copago, copago - declared_copago AS gap FROM lines JOIN dl USING (account, folio) WHERE abs(copago - declared_copago) > 500")
def q13(spark, sf):
    return Q.inconsistent_folios(_lines(spark, sf), _declared(spark, sf))


@query("q14_search_lines", f"WITH {LINES} SELECT account, count(*) AS lines, CAST(sum(valor) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago, count(DISTINCT folio) AS folios FROM lines WHERE contains(strip_accents(lower(code || ' ' || description || ' ' || provider || ' ' || folio)), 'clinico') GROUP BY account")
def q14(spark, sf):
    return Q.search_lines(star.settlement_lines(spark, sf), "clinico")


@query("q15_settlement_overview", f"WITH {LINES} SELECT (SELECT count(*) FROM lines) AS folios, count(DISTINCT provider) AS providers, count(*) AS items, CAST(sum(total) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago FROM charges")
def q15(spark, sf):
    return Q.settlement_overview(_lines(spark, sf))


@query("j42_page_slices", f"""WITH {DESCRIBED}, k AS (SELECT DISTINCT account, page FROM described WHERE {_has(PLAIN, TERMS)})
  SELECT account, page, CAST(row_number() OVER (PARTITION BY account, page ORDER BY part, provider, total, qty, folio, ts) AS INT) AS n, description, total FROM described SEMI JOIN k USING (account, page)""")
def j42(spark, sf):
    return Q.page_slices(star.described(spark, sf), TERMS)
