"""Totals, control tables and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ACCOUNTS, CHARGES, DESCRIBED, LINES, LINES_ONLY, NUMBERED
from saldo.catalog.classify import FIND, GROUP_SQL, findings
from saldo.catalog.registry import query
from saldo.functions import lexicon as lx
from saldo.operators import classify as K
from saldo.operators import reports as R
from saldo.operators import sequence
from saldo.sources import star

BIG = "CAST({} AS BIGINT)"


@query("a01_page_totals", f"""WITH {CHARGES} SELECT account, page, CAST(sum(total) AS BIGINT) AS total, count(*) AS items FROM charges WHERE page > 0 AND total > 0 GROUP BY GROUPING SETS ((account, page), (account))""")
def a01(spark, sf):
    return R.page_totals(star.charges(spark, sf))


DECL = "declared AS (SELECT account, section, CASE min(part) % 3 WHEN 0 THEN sum(total) WHEN 1 THEN floor(sum(total) * 1.19) ELSE sum(total) + 350000 END::BIGINT AS declared FROM described GROUP BY ALL)"


@query("a02_section_totals", f"""WITH {DESCRIBED}, {DECL}, c AS (SELECT account, section, CAST(sum(total) AS BIGINT) AS calculated FROM described GROUP BY ALL)
  SELECT account, section, calculated, declared, abs(declared - calculated) > 5 AS has_error, abs(declared - calculated) > 5 AND abs(calculated * 1.19::DOUBLE - declared) < declared * 0.05::DOUBLE AS tax_confusion,
  abs(declared - calculated) > 5 AND NOT abs(calculated * 1.19::DOUBLE - declared) < declared * 0.05::DOUBLE AND declared > calculated AS unjustified FROM c JOIN declared USING (account, section)""")
def a02(spark, sf):
    d = star.described(spark, sf)
    s, m = F.sum("total"), F.min("part") % 3
    declared = d.groupBy("account", "section").agg(F.when(m == 0, s).when(m == 1, F.floor(s * 1.19)).otherwise(s + 350000).cast("long").alias("declared"))
    return R.section_totals(d, declared)


@query("a03_document_balance", f"""WITH {CHARGES}, {ACCOUNTS}, e AS (SELECT account, CAST(sum(total) AS BIGINT) AS extracted FROM charges GROUP BY account)
  SELECT account, extracted, stated_total, extracted - stated_total AS discrepancy, abs(extracted - stated_total) < 10 AS balanced FROM e JOIN accounts USING (account)""")
def a03(spark, sf):
    return R.document_balance(star.charges(spark, sf), star.accounts(spark, sf).select("account", "stated_total"))


DECLARED_LINES = "dl AS (SELECT account, folio, CASE WHEN provider % 3 = 0 THEN 0 WHEN provider % 3 = 1 THEN bonif ELSE valor END AS declared_valor, CASE WHEN provider % 2 = 0 THEN bonif ELSE 0 END AS declared_bonif, CASE WHEN provider % 5 = 0 THEN copago + 600 ELSE copago END AS declared_copago FROM lines)"


def declared_lines(lines):
    p = F.col("provider")
    return lines.select("account", "folio", F.when(p % 3 == 0, 0).when(p % 3 == 1, F.col("bonif")).otherwise(F.col("valor")).alias("declared_valor"),
                        F.when(p % 2 == 0, F.col("bonif")).otherwise(0).alias("declared_bonif"),
                        F.when(p % 5 == 0, F.col("copago") + 600).otherwise(F.col("copago")).alias("declared_copago"))


@query("a04_settlement_totals", f"""WITH {LINES}, {DECLARED_LINES}, j AS (SELECT account, folio, valor, bonif, copago, coalesce(nullif(declared_valor, 0), valor) AS v, coalesce(nullif(declared_bonif, 0), bonif) AS b, coalesce(nullif(declared_copago, 0), copago) AS c FROM lines JOIN dl USING (account, folio)),
  k AS (SELECT *, CASE WHEN (v <= 0 OR v = b) AND b > 0 AND c > 0 THEN b + c ELSE v END AS vv FROM j),
  s AS (SELECT account, folio, CAST(sum(valor) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago, CAST(sum(vv) AS BIGINT) AS declared_valor, CAST(sum(b) AS BIGINT) AS declared_bonif, CAST(sum(c) AS BIGINT) AS declared_copago FROM k GROUP BY GROUPING SETS ((account, folio), (account)))
  SELECT *, copago - declared_copago AS discrepancy, abs(copago - declared_copago) <= 500 AS ok FROM s""")
def a04(spark, sf):
    lines = star.settlement_lines(spark, sf)
    return R.settlement_totals(lines, declared_lines(lines))


@query("a05_merge_under_master", f"""WITH {LINES}, m AS (SELECT *, CASE WHEN folio LIKE 'A%' THEN 'MASTER-A' WHEN folio LIKE 'R%' THEN '' END AS master FROM lines)
  SELECT account, coalesce(nullif(master, ''), folio) AS master, provider, count(*) AS lines, CAST(sum(valor) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago FROM m GROUP BY ALL""")
def a05(spark, sf):
    return R.merge_under_master(mastered(spark, sf))


def mastered(spark, sf):
    f = F.col("folio")
    return star.settlement_lines(spark, sf).withColumn("master", F.when(f.startswith("A"), "MASTER-A").when(f.startswith("R"), ""))


@query("a05_master_members", f"WITH {LINES} SELECT DISTINCT account, 'MASTER-A' AS master, folio FROM lines WHERE folio LIKE 'A%'")
def a05b(spark, sf):
    return R.master_members(mastered(spark, sf))


LINE_FINDS = "lf AS (SELECT account, description AS label, copago AS amount, CASE folio WHEN 'AF' THEN 'B' WHEN 'AO' THEN 'Z' WHEN 'RF' THEN 'A' ELSE 'K' END AS category, line_id FROM lines WHERE copago * 20 > valor)"


def line_findings(spark, sf):
    lines = star.settlement_lines(spark, sf)
    cat = K.lookup(F.col("folio"), {"AF": "B", "AO": "Z", "RF": "A"}, "K")
    return lines.filter("copago * 20 > valor").select("account", F.col("description").alias("label"), F.col("copago").alias("amount"), cat.alias("category"), "line_id")


@query("a06_control_table", f"""WITH {LINES}, {LINE_FINDS}, g AS (SELECT account, {GROUP_SQL} AS grp, copago FROM lines), t AS (SELECT account, grp, CAST(sum(copago) AS BIGINT) AS copago FROM g GROUP BY GROUPING SETS ((account, grp), (account))),
  h AS (SELECT account, CASE WHEN contains(label, 'MATERIALES') THEN 'MATERIALES' ELSE 'MEDICAMENTOS' END AS grp, count(*) AS hits, bool_or(category = 'A') AS a, bool_or(category = 'Z') AS z, bool_or(category = 'B') AS b FROM lf WHERE contains(label, 'MATERIALES') OR contains(label, 'MEDICAMENTOS') GROUP BY ALL)
  SELECT account, coalesce(t.grp, 'TOTAL') AS grp, copago, CASE WHEN t.grp IS NULL THEN '-' WHEN a THEN 'IMPROCEDENTE' WHEN z THEN 'INDETERMINADO' WHEN b THEN 'EN_CONTROVERSIA' ELSE 'VALIDABLE' END AS state,
  CASE WHEN t.grp IS NULL THEN '-' WHEN a THEN 'IMPUGNAR / EXTORNO' WHEN z THEN 'SOLICITAR ACLARACION' WHEN b THEN 'SOLICITAR DESGLOSE / RELIQUIDACION' ELSE 'OK' END AS action, coalesce(hits, 0) AS hits FROM t LEFT JOIN h USING (account, grp)""")
def a06(spark, sf):
    return R.control_table(star.settlement_lines(spark, sf), line_findings(spark, sf))


LSUMS = "ls AS (SELECT account, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (WHERE category = '{k}'), 0) AS BIGINT) AS {k}" for k in "ABKZ") + " FROM lf GROUP BY account)"


@query("a07_reconciliation", f"""WITH {LINES}, {LINE_FINDS}, {LSUMS}, c AS (SELECT account, CAST(sum(copago) AS BIGINT) AS copago FROM lines GROUP BY account), s AS (SELECT account, A, B, Z, copago, greatest(0, copago - A - B - Z) AS OK FROM ls JOIN c USING (account))
  SELECT account, 'A' AS category, A AS amount FROM s UNION ALL SELECT account, 'B', B FROM s UNION ALL SELECT account, 'OK', OK FROM s UNION ALL SELECT account, 'Z', Z FROM s UNION ALL SELECT account, 'TOTAL', CASE WHEN copago > 0 THEN copago ELSE A + B + OK + Z END FROM s""")
def a07(spark, sf):
    sums = R.category_sums(line_findings(spark, sf))
    copago = star.settlement_lines(spark, sf).groupBy("account").agg(F.sum("copago").alias("copago"))
    return R.reconciliation(sums.join(copago, "account"))


MAT = "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i){p}') THEN '{n}'" for n, p in lx.MATERIAL_BUCKETS) + f" ELSE '{lx.MATERIAL_OTHER}' END"
HOT = "CASE " + " ".join(f"WHEN regexp_matches(description, '(?i){p}') THEN '{n}'" for n, p in lx.HOTEL_BUCKETS) + f" ELSE '{lx.HOTEL_OTHER}' END"


@query("a08_composition", f"""WITH {DESCRIBED}, m AS (SELECT 'MATERIAL' AS kind, {MAT} AS bucket, total FROM described WHERE regexp_matches(section, 'MATERIALES|FARMACIA|INSUM') OR contains(description, 'MATERIAL')
  UNION ALL SELECT 'HOTEL', {HOT}, total FROM described WHERE contains(section, 'ALIMENTACION') OR regexp_matches(description, 'ALMUERZO|KIT INGRESO|TERMOMETRO|PAÑO'))
  SELECT kind, coalesce(bucket, 'TOTAL') AS bucket, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM m GROUP BY GROUPING SETS ((kind, bucket), (kind))""")
def a08(spark, sf):
    d = star.described(spark, sf)
    s, t = F.col("section"), F.col("description")
    mat = R.composition(d.filter(R.is_material(s, t)), K.material_bucket(t)).withColumn("kind", F.lit("MATERIAL"))
    hot = R.composition(d.filter(R.is_hotel(s, t)), K.hotel_bucket(t, s)).withColumn("kind", F.lit("HOTEL"))
    return mat.unionByName(hot)


@query("a09_findings_table", f"WITH {LINES}, {LINE_FINDS} SELECT account, row_number() OVER (PARTITION BY account ORDER BY amount DESC, line_id) AS n, label, amount, CASE category WHEN 'A' THEN 'IMPROCEDENTE (Exigible)' WHEN 'B' THEN 'EN CONTROVERSIA' WHEN 'Z' THEN 'INDETERMINADO' ELSE 'N/A' END AS state FROM lf WHERE amount > 0")
def a09(spark, sf):
    from saldo.operators import findings as fo
    return fo.numbered_table(line_findings(spark, sf).withColumn("subsumed", F.col("amount") <= 0))


@query("a16_simple_balance", f"""WITH {LINES}, {LINE_FINDS}, {LSUMS}, c AS (SELECT account, CAST(sum(copago) AS BIGINT) AS copago FROM lines GROUP BY account) SELECT account, A, B, Z, greatest(0, copago - A - B - Z) AS OK, copago AS total FROM c JOIN ls USING (account)""")
def a16(spark, sf):
    from saldo.operators import balance
    copago = star.settlement_lines(spark, sf).groupBy("account").agg(F.sum("copago").alias("copago"))
    return balance.simple_balance(line_findings(spark, sf), copago)


@query("a34_quality_gates", f"""WITH {DESCRIBED}, {ACCOUNTS}, g AS (SELECT account, count(*) AS n, sum(total) AS extracted, count(*) FILTER (WHERE qty > 0 AND unit_price > 0 AND total > 0 AND abs(floor(qty * unit_price + 0.5) - total) > greatest(100, floor(qty * unit_price + 0.5) * 0.2)) AS math_mismatch,
  count(*) FILTER (WHERE section <> '') AS coded FROM described GROUP BY account), j AS (SELECT g.*, priority <> '5-LOW' AS strict, CASE WHEN account % 2 = 0 THEN extracted ELSE stated_total END AS target FROM g JOIN accounts USING (account)),
  w AS (SELECT account, n, math_mismatch, strict, abs(extracted - target) <= 1 AS exact, math_mismatch = 0 AS math, coded::DOUBLE / n >= 0.99 AS code FROM j)
  SELECT account, n, math_mismatch, CASE WHEN strict THEN 'PASS' ELSE 'FAIL' END AS strict_quality, CASE WHEN exact THEN 'PASS' ELSE 'FAIL' END AS reconciliation_exact, CASE WHEN math THEN 'PASS' ELSE 'FAIL' END AS math_consistency,
    CASE WHEN code THEN 'PASS' ELSE 'FAIL' END AS code_coverage, 'PASS' AS date_coverage, 'PASS' AS quantity_coverage, 'PASS' AS unit_price_coverage, CASE WHEN strict AND exact AND math AND code THEN 'PASS' ELSE 'FAIL' END AS overall FROM w""")
def a34(spark, sf):
    d = star.described(spark, sf).withColumn("code", F.col("section"))
    sums = star.charges(spark, sf).groupBy("account").agg(F.sum("total").alias("s"))
    t = star.accounts(spark, sf).join(sums, "account").select("account", (F.col("priority") != "5-LOW").alias("strict"),
                                                              F.when(F.col("account") % 2 == 0, F.col("s")).otherwise(F.col("stated_total")).alias("target"))
    return R.quality_gates(d, t)


@query("a35_declared_target", f"""WITH {CHARGES}, {ACCOUNTS}, e AS (SELECT account, CAST(sum(total) AS BIGINT) AS extracted, CAST(sum(bonif) AS BIGINT) AS subtotals FROM charges GROUP BY account),
  j AS (SELECT account, extracted, CASE WHEN account % 3 = 0 THEN 0 ELSE stated_total END AS bd, CASE WHEN account % 2 = 0 THEN 0 ELSE extracted END AS cd, subtotals FROM e JOIN accounts USING (account)),
  t AS (SELECT *, CASE WHEN bd > 0 THEN bd WHEN cd > 0 THEN cd ELSE subtotals END AS target FROM j)
  SELECT account, CASE WHEN bd > 0 THEN 'billDeclaredTotal' WHEN cd > 0 THEN 'clinicTotalGeneral' WHEN subtotals > 0 THEN 'subtotalIsapreSum' ELSE 'unknown' END AS source, target, extracted,
  CASE WHEN target <= 0 THEN 'NO_TARGET' WHEN abs(extracted - target) <= 1 THEN 'OK' WHEN extracted::DOUBLE / target > 1.2 THEN 'OVER' WHEN extracted::DOUBLE / target < 0.8 THEN 'UNDER' ELSE 'GAP' END AS status FROM t""")
def a35(spark, sf):
    e = star.charges(spark, sf).groupBy("account").agg(F.sum("total").alias("extracted"), F.sum("bonif").alias("subtotals"))
    a = F.col("account")
    j = e.join(star.accounts(spark, sf), "account").withColumns({
        "bill_declared": F.when(a % 3 == 0, 0).otherwise(F.col("stated_total")), "clinic_declared": F.when(a % 2 == 0, 0).otherwise(F.col("extracted"))})
    return R.declared_target(j)


@query("a35_dead_pages", f"WITH {CHARGES} SELECT DISTINCT account, page FROM charges WHERE (account, page) NOT IN (SELECT account, CASE WHEN folio LIKE 'R%' THEN page + 10 ELSE page END FROM charges)")
def a35b(spark, sf):
    c = star.charges(spark, sf)
    return R.dead_pages(c, c.withColumn("page", F.when(F.col("folio").startswith("R"), F.col("page") + 10).otherwise(F.col("page"))))


BLOCK_ITEMS = """bi AS (SELECT account, page, total AS item_total, total + copago AS gross, bonif AS insurer, copago AS patient, total + total * 19 // 100 AS taxed, total + copago + total * 19 // 100 AS exempt_and_taxed FROM charges),
  st AS (SELECT account, page, CAST(sum(bonif) * 3 AS BIGINT) AS amount FROM charges WHERE page IN (3, 5, 7) GROUP BY ALL)"""


@query("a36_subtotal_blocks", f"""WITH {CHARGES}, {BLOCK_ITEMS}, b AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY account ORDER BY page), 0) AS prev FROM st),
  g AS (SELECT b.account, b.page AS end_page, b.amount AS target, min(bi.page) AS first_page, count(bi.page) AS items, coalesce(sum(item_total), 0) AS m0, coalesce(sum(gross), 0) AS m1, coalesce(sum(insurer), 0) AS m2, coalesce(sum(patient), 0) AS m3, coalesce(sum(taxed), 0) AS m4, coalesce(sum(exempt_and_taxed), 0) AS m5
    FROM b LEFT JOIN bi ON bi.account = b.account AND bi.page > prev AND bi.page <= b.page GROUP BY ALL),
  u AS (SELECT account, least(first_page, end_page) AS start_page, end_page, target, items, list_sort([{{'gap': abs(m0 - target), 'i': 0, 'n': 'item_total'}}, {{'gap': abs(m1 - target), 'i': 1, 'n': 'gross'}}, {{'gap': abs(m2 - target), 'i': 2, 'n': 'insurer'}}, {{'gap': abs(m3 - target), 'i': 3, 'n': 'patient'}}, {{'gap': abs(m4 - target), 'i': 4, 'n': 'taxed'}}, {{'gap': abs(m5 - target), 'i': 5, 'n': 'exempt_and_taxed'}}])[1] AS best FROM g)
  SELECT account, start_page, end_page, target, items, CAST(best.gap AS BIGINT) AS gap, best.n AS closest FROM u""")
def a36(spark, sf):
    c = star.charges(spark, sf)
    vat = F.expr("total * 19 div 100")
    bi = c.select("account", "page", F.col("total").alias("item_total"), (F.col("total") + F.col("copago")).alias("gross"), F.col("bonif").alias("insurer"),
                  F.col("copago").alias("patient"), (F.col("total") + vat).alias("taxed"), (F.col("total") + F.col("copago") + vat).alias("exempt_and_taxed"))
    st = c.filter(F.col("page").isin(3, 5, 7)).groupBy("account", "page").agg((F.sum("bonif") * 3).alias("amount"))
    return R.subtotal_blocks(bi, st)


@query("w14_subtotal_ranges", f"WITH {CHARGES}, p AS (SELECT DISTINCT account, page FROM charges WHERE page IN (3, 5, 7)) SELECT account, page, lag(page) OVER (PARTITION BY account ORDER BY page) AS previous, lead(page) OVER (PARTITION BY account ORDER BY page) AS following FROM p")
def w14(spark, sf):
    p = star.charges(spark, sf).filter(F.col("page").isin(3, 5, 7)).select("account", "page").distinct()
    return sequence.carry(p, ["account"], ["page"], sequence.by_pos("page"), before={"previous": F.col("page")}, after={"following": F.col("page")})


@query("a56_source_histogram", "SELECT source, count(*) AS pages FROM documents GROUP BY source")
def a56(spark, sf):
    return star.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("pages"))


@query("a58_provider_summary", f"WITH {CHARGES} SELECT account, folio, provider, count(*) AS items FROM charges GROUP BY ALL")
def a58(spark, sf):
    return R.provider_summary(star.charges(spark, sf))


@query("a59_event_integrity", f"WITH {CHARGES}, {ACCOUNTS}, e AS (SELECT account, sum(copago) FILTER (WHERE ts < TIMESTAMP '1998-01-01') AS ev FROM charges GROUP BY account) SELECT account, stated_total AS declared FROM accounts LEFT JOIN e USING (account) WHERE stated_total > 0 AND coalesce(ev, 0) = 0")
def a59(spark, sf):
    ev = star.charges(spark, sf).filter("ts < '1998-01-01'")
    return R.event_integrity(ev, star.accounts(spark, sf).select("account", F.col("stated_total").alias("declared")))


@query("a61_principal_provider", f"""WITH {CHARGES}, p AS (SELECT account, provider, sum(total) AS v FROM charges GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY v DESC, provider) AS n FROM p),
  h AS (SELECT account, max(CASE WHEN provider % 10 = 3 THEN 'Clinica ' || provider END) AS h FROM charges GROUP BY account) SELECT account, coalesce(h, CAST(provider AS VARCHAR)) AS principal FROM r JOIN h USING (account) WHERE n = 1""")
def a61(spark, sf):
    p = F.col("provider")
    return R.principal_provider(star.charges(spark, sf).withColumnRenamed("total", "valor"), F.when(p % 10 == 3, F.concat(F.lit("Clinica "), p.cast("string"))))


@query("a62_literal_totals", f"WITH {LINES} SELECT account, CAST(sum(valor) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago, count(DISTINCT folio) AS sources FROM lines WHERE folio LIKE '%F' GROUP BY account")
def a62(spark, sf):
    f = star.settlement_lines(spark, sf).withColumn("source_text", F.when(F.col("folio").endswith("F"), F.concat(F.lit("[P1] Total "), "folio")).otherwise(F.lit("Subtotales")))
    return R.literal_totals(f)
