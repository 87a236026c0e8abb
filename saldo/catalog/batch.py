"""Contracts side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, PARTS
from saldo.catalog.contracts import ASG, SIM_MAP, assignments
from saldo.catalog.registry import query
from saldo.catalog.sequences import LNS, contract_lines
from saldo.operators import classify as K
from saldo.operators import contracts as C
from saldo.operators import packages as P
from saldo.sources import star

PC = "pc AS (SELECT contract_id, 'COL_' || CASE size % 5 WHEN 0 THEN 'PREF_PCT' WHEN 1 THEN 'LE_PCT' WHEN 2 THEN 'PREF_TOPE' WHEN 3 THEN 'LE_TOPE' ELSE 'X' || (contract_id % 3) END AS column_id FROM lns)"


def package_columns(spark, sf):
    s = F.col("size") % 5
    return contract_lines(spark, sf).select("contract_id", F.concat(F.lit("COL_"), F.when(s == 0, "PREF_PCT").when(s == 1, "LE_PCT").when(s == 2, "PREF_TOPE").when(s == 3, "LE_TOPE").otherwise(
        F.concat(F.lit("X"), (F.col("contract_id") % 3).cast("string")))).alias("column_id"))


@query("a37_contract_families", f"""WITH {LNS}, {PC}, s AS (SELECT contract_id, string_agg(DISTINCT column_id, '|' ORDER BY column_id) AS c FROM pc GROUP BY contract_id), n AS (SELECT contract_id, count(*) AS n FROM lns GROUP BY contract_id)
  SELECT contract_id, 'FAMILY[' || c || '][' || CASE WHEN n < 5 THEN 'LITE' WHEN n < 15 THEN 'STANDARD' ELSE 'COMPLEX' END || ']' AS family FROM s JOIN n USING (contract_id)""")
def a37(spark, sf):
    return P.families(package_columns(spark, sf), contract_lines(spark, sf))


@query("a38_cell_variance", f"""WITH {LNS}, v AS (SELECT noun AS row_id, 'C' || (size % 5) AS column_id, p_type AS value, count(DISTINCT contract_id) AS contracts FROM lns GROUP BY ALL) SELECT *, count(*) OVER (PARTITION BY row_id, column_id) > 1 AS varies FROM v""")
def a38(spark, sf):
    return P.cell_variance(contract_lines(spark, sf).select("contract_id", F.col("noun").alias("row_id"), F.concat(F.lit("C"), (F.col("size") % 5).cast("string")).alias("column_id"), F.col("p_type").alias("value")))


@query("a39_batch_summary", f"WITH {LNS}, s AS (SELECT contract_id, CASE max(size) % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'NEEDS_REVIEW' END AS status FROM lns GROUP BY contract_id) SELECT count(*) AS contracts, count(*) FILTER (WHERE status <> 'NEEDS_REVIEW') AS passed, count(*) FILTER (WHERE status = 'NEEDS_REVIEW') AS review, count(*) FILTER (WHERE status <> 'NEEDS_REVIEW')::DOUBLE / count(*) AS rate FROM s")
def a39(spark, sf):
    m = F.max("size") % 3
    s = contract_lines(spark, sf).groupBy("contract_id").agg(F.when(m == 0, "PASS").when(m == 1, "WARN").otherwise("NEEDS_REVIEW").alias("status"))
    return P.batch_summary(s)


ROWMAP = {"ring": "R_DIA_CAMA", "bolt": "R_HONORARIOS", "gear": "R_PABELLON", "rod": "R_MEDICAMENTOS", "plate": "R_EXAMENES"}
MC = """mc AS (SELECT contract_id, CASE noun WHEN 'ring' THEN 'R_DIA_CAMA' WHEN 'bolt' THEN 'R_HONORARIOS' WHEN 'gear' THEN 'R_PABELLON' WHEN 'rod' THEN 'R_MEDICAMENTOS' WHEN 'plate' THEN 'R_EXAMENES' ELSE 'R_' || noun END AS row_id, CASE WHEN size % 4 = 0 THEN 'Sin Tope' ELSE CAST(size AS VARCHAR) END AS value, CASE size % 3 WHEN 0 THEN '%' WHEN 1 THEN 'UF' ELSE 'AC2' END AS unit FROM lns)"""
MET = f"""{LNS}, {PC}, {MC}, m0 AS (SELECT contract_id, count(DISTINCT row_id) AS rows, CAST(count(DISTINCT row_id) FILTER (WHERE row_id IN ('R_DIA_CAMA', 'R_HONORARIOS', 'R_PABELLON', 'R_MEDICAMENTOS', 'R_MATERIALES', 'R_EXAMENES', 'R_CONSULTAS')) AS INT) AS critical_found, count(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = 'UF') AS uf_caps, min(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = 'UF') AS uf_min, max(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = 'UF') AS uf_max,
   count(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = '%') AS percents, max(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = '%') AS max_coverage, count(TRY_CAST(value AS DOUBLE)) FILTER (WHERE unit = 'AC2') AS fee_multiples, count(*) FILTER (WHERE value = 'Sin Tope') AS uncapped FROM mc GROUP BY contract_id),
  mp AS (SELECT contract_id, count(*) FILTER (WHERE regexp_matches(lower(column_id), 'pref|red')) AS preferred_columns, count(*) FILTER (WHERE regexp_matches(lower(column_id), 'libre|le')) AS free_columns FROM pc GROUP BY contract_id), met AS (SELECT m0.*, preferred_columns, free_columns, 7 - critical_found AS critical_missing, CASE WHEN 7 - critical_found > 3 THEN 'WARN' ELSE 'SUCCESS' END AS status FROM m0 LEFT JOIN mp USING (contract_id))"""


def metrics(spark, sf):
    s = F.col("size")
    cells = contract_lines(spark, sf).select("contract_id", K.lookup(F.col("noun"), ROWMAP, F.concat(F.lit("R_"), "noun")).alias("row_id"),
                                                                               F.when(s % 4 == 0, "Sin Tope").otherwise(s.cast("string")).alias("value"), F.when(s % 3 == 0, "%").when(s % 3 == 1, "UF").otherwise("AC2").alias("unit"))
    return P.contract_metrics(cells, package_columns(spark, sf))


@query("a40_contract_metrics", f"WITH {MET} SELECT * FROM met")
def a40(spark, sf):
    return metrics(spark, sf)


@query("a41_cross_report", f"WITH {MET} SELECT count(*) AS contracts, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE status = 'SUCCESS')::DOUBLE / count(*) AS rate, CAST(sum(uncapped) AS BIGINT) AS uncapped FROM met")
def a41(spark, sf):
    return P.cross_report(metrics(spark, sf))


@query("p40_contract_family", f"WITH {LNS}, n AS (SELECT contract_id, count(*) FILTER (WHERE noun = 'rod' AND size < 25) AS n, bool_or(size = 1) AS w FROM lns GROUP BY contract_id) SELECT contract_id, CASE WHEN n < 5 THEN 'B' WHEN w THEN 'C' ELSE 'A' END AS family FROM n")
def p40(spark, sf):
    n = contract_lines(spark, sf).groupBy("contract_id").agg(F.count_if((F.col("noun") == "rod") & (F.col("size") < 25)).alias("n"), F.bool_or(F.col("size") == 1).alias("w"))
    return n.select("contract_id", K.contract_family(F.col("n"), F.when(F.col("w"), "WARN").otherwise("PASS")).alias("family"))


@query("p52_well_formed", f"WITH {LNS} SELECT contract_id, count(*) AS cells FROM lns WHERE size % 9 <> 0 AND noun <> 'rod' GROUP BY contract_id")
def p52(spark, sf):
    s = F.col("size")
    cells = contract_lines(spark, sf).select("contract_id", F.when(s % 9 != 0, F.col("noun")).alias("row_id"), F.when(F.col("noun") != "rod", "C").alias("column_id"), F.col("line_no").alias("assignment_id"))
    return P.well_formed(cells).groupBy("contract_id").agg(F.count("*").alias("cells"))


SIM = f"""{DESCRIBED}, {ASG}, sec AS (SELECT section, sum(total) AS total FROM described GROUP BY section), mp AS (SELECT * FROM (VALUES ('PABELLON', 'R_GEAR'), ('PABELLON', 'R_ROD'), ('HOSPITALIZACION', 'R_PLATE'), ('FARMACIA', 'R_BOLT')) t(section, row_id)),
  f AS (SELECT contract_id, section, total, arg_min((value, unit), pos) AS a FROM asg JOIN mp USING (row_id) JOIN sec USING (section) GROUP BY ALL), c AS (SELECT contract_id, sum(total * CASE WHEN contains(lower(a[1]), 'sin tope') THEN 1.0 WHEN a[2] = '%' THEN CAST(a[1] AS DOUBLE) / 100 ELSE 0.5 END) AS covered FROM f GROUP BY contract_id),
  sim AS (SELECT contract_id, CAST(coalesce(floor(covered + 0.5), 0) AS BIGINT) AS covered FROM (SELECT DISTINCT contract_id FROM asg) LEFT JOIN c USING (contract_id))"""


@query("j40_contract_simulation", f"WITH {SIM} SELECT * FROM sim")
def j40(spark, sf):
    return C.simulate_coverage(star.described(spark, sf), assignments(spark, sf), SIM_MAP).select("contract_id", "covered")


@query("o05_best_and_worst", f"WITH {SIM} SELECT * FROM (SELECT 'BEST' AS side, contract_id, covered FROM sim ORDER BY covered DESC, contract_id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'WORST', contract_id, covered FROM sim ORDER BY covered, contract_id LIMIT 5)")
def o05(spark, sf):
    return P.extremes(C.simulate_coverage(star.described(spark, sf), assignments(spark, sf), SIM_MAP))


@query("j38_golden_diff", f"WITH {LNS}, e AS (SELECT line_no AS id FROM lns WHERE p_type <> 'PROMO'), a AS (SELECT line_no AS id FROM lns WHERE noun <> 'ring') SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'MISSING' ELSE 'EXTRA' END AS diff FROM e FULL JOIN a ON e.id = a.id WHERE e.id IS NULL OR a.id IS NULL")
def j38(spark, sf):
    l = contract_lines(spark, sf).select(F.col("line_no").alias("id"), "p_type", "noun")
    return P.golden_diff(l.filter("p_type <> 'PROMO'"), l.filter("noun <> 'ring'"), "id")


@query("j38_golden_verdict", f"WITH {LNS} SELECT count(*) FILTER (WHERE noun = 'ring' AND p_type <> 'PROMO') AS missing, count(*) FILTER (WHERE p_type = 'PROMO' AND noun <> 'ring') AS extra, 'REGRESSION' AS verdict FROM lns")
def j38b(spark, sf):
    return P.verdict(j38(spark, sf))


@query("j39_missing_items", f"WITH {DESCRIBED}, e AS (SELECT section AS grp, description, CASE WHEN page = 7 THEN -total ELSE total END AS total FROM described) SELECT grp, count(*) AS missing, CAST(sum(total) AS BIGINT) AS amount FROM e WHERE (description, total) NOT IN (SELECT description, total FROM described) GROUP BY grp")
def j39(spark, sf):
    d = star.described(spark, sf)
    e = d.select(F.col("section").alias("grp"), "description", F.when(F.col("page") == 7, -F.col("total")).otherwise(F.col("total")).alias("total"))
    return P.missing_items(e, d)


@query("u03_set_difference", f"WITH {CHARGES} SELECT 'ONLY_A' AS side, provider, page FROM (SELECT provider, page FROM charges WHERE folio LIKE '%F' EXCEPT SELECT provider, page FROM charges WHERE folio NOT LIKE '%F') UNION ALL SELECT 'BOTH', provider, page FROM (SELECT provider, page FROM charges WHERE folio LIKE '%F' INTERSECT SELECT provider, page FROM charges WHERE folio NOT LIKE '%F')")
def u03(spark, sf):
    c = star.charges(spark, sf)
    a, b = c.filter("folio like '%F'").select("provider", "page"), c.filter("folio not like '%F'").select("provider", "page")
    return a.subtract(b).withColumn("side", F.lit("ONLY_A")).unionByName(a.intersect(b).withColumn("side", F.lit("BOTH")))


@query("u04_multiset_compare", f"WITH {CHARGES} SELECT provider, page, 'LEFT' AS side FROM (SELECT provider, page FROM charges WHERE folio LIKE '%F' EXCEPT ALL SELECT provider, page FROM charges WHERE folio NOT LIKE '%F') UNION ALL SELECT provider, page, 'RIGHT' FROM (SELECT provider, page FROM charges WHERE folio NOT LIKE '%F' EXCEPT ALL SELECT provider, page FROM charges WHERE folio LIKE '%F')")
def u04(spark, sf):
    c = star.charges(spark, sf)
    return P.same_rows(c.filter("folio like '%F'").select("provider", "page"), c.filter("folio not like '%F'").select("provider", "page"))
