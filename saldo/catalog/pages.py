"""Contract pages: geometry, spans, zones, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES
from saldo.catalog.registry import query
from saldo.catalog.scalars import CELLS, _cells
from saldo.catalog.sequences import GEO, LNS, contract_lines, geometry
from saldo.operators import spatial as S
from saldo.sources import star

K = ["contract_id"]
COLS = "cols AS (SELECT DISTINCT contract_id, 'C' || (size % 7) AS column_id, (size % 7) * 0.14::DOUBLE AS x0, (size % 7) * 0.14::DOUBLE + 0.12::DOUBLE AS x1 FROM lns WHERE size <= 40)"
ROWS = "rws AS (SELECT contract_id, 'R_' || upper(noun) || '_' || line_no AS row_id, noun, y0, y1 FROM geo)"
ASG = f"""{CHARGES}, asg AS (SELECT contract_id, account || ':' || page || ':' || part || ':' || provider AS assignment_id, 'C' || (page - 1) AS column_id, 'R_' || upper(noun) || '_' || (part + CASE WHEN part % 50 = 0 THEN 1000000 ELSE 0 END) AS row_id, (part % 97) / 97.0::DOUBLE * 0.9::DOUBLE AS bx0, (part % 97) / 97.0::DOUBLE * 0.9::DOUBLE + 0.05::DOUBLE AS bx1,
  CASE page WHEN 1 THEN 'EXCLUDED' WHEN 2 THEN 'CONDITIONAL' WHEN 3 THEN 'UNDETERMINED' ELSE 'ACTIVE' END AS status, CAST(total % 100 AS DOUBLE) / 100 AS confidence, CASE WHEN folio LIKE 'R%' THEN 'ZONE_REFERENCE' WHEN folio = 'AF' THEN 'TEXT_ECHO_HEADER' ELSE 'TEXT_DIRECT_CELL' END AS pointer_type,
  'Z' || (part - part % 3) AS target_id, CASE WHEN part % 2 = 0 THEN ['CONDITION'] ELSE ['RULE', 'TEXT_DIRECT'] END AS atom_types FROM charges JOIN lns ON line_no = part)"""


def columns(spark, sf):
    k = F.col("size") % 7
    return contract_lines(spark, sf).filter("size <= 40").select("contract_id", F.concat(F.lit("C"), k.cast("string")).alias("column_id"), (k * 0.14).alias("x0"), (k * 0.14 + 0.12).alias("x1")).distinct()


def rows(spark, sf):
    return geometry(spark, sf).select("contract_id", F.concat(F.lit("R_"), F.upper("noun"), F.lit("_"), F.col("line_no").cast("string")).alias("row_id"), "noun", "y0", "y1")


def assignments(spark, sf):
    c, col = star.charges(spark, sf), F.col
    j = c.join(contract_lines(spark, sf).select("contract_id", col("line_no").alias("part"), "noun"), "part")
    s = lambda x: col(x).cast("string")
    bx0 = (col("part") % 97) / 97.0 * 0.9
    p = col("page")
    return j.select("contract_id", F.concat_ws(":", s("account"), s("page"), s("part"), s("provider")).alias("assignment_id"), F.concat(F.lit("C"), (p - 1).cast("string")).alias("column_id"),
                    F.concat(F.lit("R_"), F.upper("noun"), F.lit("_"), (col("part") + F.when(col("part") % 50 == 0, 1000000).otherwise(0)).cast("string")).alias("row_id"), bx0.alias("bx0"), (bx0 + 0.05).alias("bx1"),
                    F.when(p == 1, "EXCLUDED").when(p == 2, "CONDITIONAL").when(p == 3, "UNDETERMINED").otherwise("ACTIVE").alias("status"), ((col("total") % 100).cast("double") / 100).alias("confidence"),
                    F.when(col("folio").startswith("R"), "ZONE_REFERENCE").when(col("folio") == "AF", "TEXT_ECHO_HEADER").otherwise("TEXT_DIRECT_CELL").alias("pointer_type"),
                    F.concat(F.lit("Z"), (col("part") - col("part") % 3).cast("string")).alias("target_id"),
                    F.when(col("part") % 2 == 0, F.array(F.lit("CONDITION"))).otherwise(F.array(F.lit("RULE"), F.lit("TEXT_DIRECT"))).alias("atom_types"))


ZON = "zon AS (SELECT contract_id, 'Z' || line_no AS zone_id, CASE WHEN p_type = 'SMALL' THEN 'ZONE_EXCLUSION' ELSE 'ZONE_GRAPHIC_RULE' END AS zone_type, CASE WHEN size = 50 THEN 'ROW_BAND' ELSE 'RECT' END AS scope_mode, y0, y0 + 0.03::DOUBLE AS y1, CASE WHEN size % 3 = 0 THEN 'Salvo en Clinica Norte' ELSE 'Regla' END AS text, size % 2 = 0 AS has_conditions FROM geo WHERE p_type IN ('PROMO', 'SMALL'))"


def zones(spark, sf):
    s = F.col("size")
    return geometry(spark, sf).filter(F.col("p_type").isin("PROMO", "SMALL")).select(
        "contract_id", F.concat(F.lit("Z"), F.col("line_no").cast("string")).alias("zone_id"), F.when(F.col("p_type") == "SMALL", "ZONE_EXCLUSION").otherwise("ZONE_GRAPHIC_RULE").alias("zone_type"),
        F.when(s == 50, "ROW_BAND").otherwise("RECT").alias("scope_mode"), "y0", (F.col("y0") + 0.03).alias("y1"), F.when(s % 3 == 0, "Salvo en Clinica Norte").otherwise("Regla").alias("text"), (s % 2 == 0).alias("has_conditions"))


@query("j33_row_integrity", f"WITH {LNS}, {GEO}, {ROWS}, {ASG} SELECT contract_id, assignment_id, row_id FROM asg WHERE (contract_id, row_id) NOT IN (SELECT contract_id, row_id FROM rws)")
def j33(spark, sf):
    return S.orphan_assignments(assignments(spark, sf), rows(spark, sf)).select("contract_id", "assignment_id", "row_id")


CHK = """hit AS (SELECT a.contract_id, assignment_id, bool_or(c.column_id = a.column_id) AS v, arg_min(c.column_id, (x0, c.column_id)) AS f FROM asg a JOIN cols c ON c.contract_id = a.contract_id AND (bx0 + bx1) / 2 >= x0 - 0.01::DOUBLE AND (bx0 + bx1) / 2 <= x1 + 0.01::DOUBLE GROUP BY ALL),
  chk AS (SELECT a.contract_id, a.assignment_id, a.column_id, coalesce(v, false) AS valid, CASE WHEN NOT coalesce(v, false) THEN f END AS correct_column FROM asg a LEFT JOIN hit USING (contract_id, assignment_id))"""


@query("j34_column_check", f"WITH {LNS}, {COLS}, {ASG}, {CHK} SELECT * FROM chk")
def j34(spark, sf):
    return S.column_check(assignments(spark, sf), columns(spark, sf))


@query("j35_covered_rows", f"WITH {LNS}, {GEO}, {ROWS}, {ZON} SELECT contract_id, row_id, EXISTS (SELECT 1 FROM zon z WHERE z.contract_id = r.contract_id AND zone_type <> 'ZONE_EXCLUSION' AND (scope_mode = 'ROW_BAND' OR (r.y0 < z.y1 AND r.y1 > z.y0))) AS has_zone FROM rws r")
def j35(spark, sf):
    return S.covered_rows(rows(spark, sf), zones(spark, sf)).select("contract_id", "row_id", "has_zone")


@query("a43_coverage_metrics", f"""WITH {LNS}, {GEO}, {ROWS}, {ZON}, p AS (SELECT contract_id, CASE WHEN noun IN ('ring', 'bolt') THEN 'REQUIRE' WHEN noun = 'gear' THEN 'NONE' ELSE 'ALLOW' END AS pol, EXISTS (SELECT 1 FROM zon z WHERE z.contract_id = r.contract_id AND zone_type <> 'ZONE_EXCLUSION' AND (scope_mode = 'ROW_BAND' OR (r.y0 < z.y1 AND r.y1 > z.y0))) AS hz FROM rws r),
  g AS (SELECT contract_id, count(*) FILTER (WHERE pol = 'REQUIRE') AS expected, count(*) FILTER (WHERE pol = 'REQUIRE' AND hz) AS covered, count(*) FILTER (WHERE pol = 'NONE' AND hz) AS unexpected FROM p GROUP BY contract_id)
  SELECT *, CASE WHEN expected > 0 THEN covered::DOUBLE / expected ELSE 1.0 END AS rate, CASE WHEN covered < expected THEN 'FAIL' WHEN unexpected > 0 THEN 'WARN' ELSE 'PASS' END AS gate FROM g""")
def a43(spark, sf):
    return S.coverage_metrics(rows(spark, sf), zones(spark, sf), S.row_policy(F.col("row_id"), [("RING|BOLT", "REQUIRE"), ("GEAR", "NONE")]))


MISS = "ms AS (SELECT a.contract_id, assignment_id, target_id FROM asg a JOIN zon z ON z.contract_id = a.contract_id AND z.zone_id = a.target_id WHERE z.text LIKE 'Salvo%' AND NOT list_contains(atom_types, 'CONDITION'))"


@query("j36_missing_conditions", f"WITH {LNS}, {GEO}, {ZON}, {ASG}, {MISS} SELECT * FROM ms")
def j36(spark, sf):
    return S.missing_conditions(assignments(spark, sf), zones(spark, sf))


@query("j36_unflagged_zones", f"WITH {LNS}, {GEO}, {ZON} SELECT contract_id, zone_id FROM zon WHERE text LIKE 'Salvo%' AND NOT has_conditions")
def j36b(spark, sf):
    return S.unflagged_zones(zones(spark, sf)).select("contract_id", "zone_id")


PZ = """pz0 AS (SELECT DISTINCT contract_id, row_id, column_id FROM asg WHERE pointer_type = 'TEXT_ECHO_HEADER'), pz1 AS (SELECT p.*, x0, x1, y0, y1, CASE WHEN y0 IS NULL THEN row_number() OVER (PARTITION BY p.contract_id, y0 IS NULL ORDER BY row_id, column_id) END AS n FROM pz0 p LEFT JOIN cols USING (contract_id, column_id) LEFT JOIN rws USING (contract_id, row_id)),
  pz AS (SELECT contract_id, 'ZONE_PROMOTED_HEADER_' || row_id || '_' || column_id AS zone_id, coalesce(x0, 0.4::DOUBLE) AS x0, coalesce(x1, 0.6::DOUBLE) AS x1, round(coalesce(y0, 0.3::DOUBLE + (n - 1) * 0.02::DOUBLE), 6) AS y0, round(coalesce(y1, coalesce(y0, 0.3::DOUBLE + (n - 1) * 0.02::DOUBLE) + 0.02::DOUBLE), 6) AS y1, y0 IS NULL AS synthetic FROM pz1)"""


@query("w17_promoted_zones", f"WITH {LNS}, {GEO}, {COLS}, {ROWS}, {ASG}, {PZ} SELECT * FROM pz")
def w17(spark, sf):
    return S.promoted_zones(assignments(spark, sf), columns(spark, sf), rows(spark, sf))


GATES = f"""{LNS}, {GEO}, {COLS}, {ROWS}, {ZON}, {ASG}, {CHK}, {MISS}, {PZ}, br AS (SELECT DISTINCT contract_id FROM asg WHERE (contract_id, row_id) NOT IN (SELECT contract_id, row_id FROM rws)),
  ov AS (SELECT contract_id, max(n) AS n FROM (SELECT contract_id, row_id, column_id, count(*) AS n FROM asg WHERE status = 'ACTIVE' GROUP BY ALL) GROUP BY contract_id), dp AS (SELECT contract_id, max(n) AS n FROM (SELECT contract_id, assignment_id, count(*) AS n FROM asg GROUP BY ALL) GROUP BY contract_id),
  gt AS (SELECT contract_id, count(*) AS assignments, count(*) FILTER (WHERE status = 'ACTIVE') AS active, count(*) FILTER (WHERE status = 'EXCLUDED') AS excluded, count(*) FILTER (WHERE status = 'CONDITIONAL') AS conditional, count(*) FILTER (WHERE status = 'UNDETERMINED') AS undetermined, sum(CAST(confidence AS DECIMAL(18,4))) AS cf,
    bool_or(status = 'ACTIVE' AND pointer_type = 'ZONE_REFERENCE' AND NOT list_contains(atom_types, 'TEXT_DIRECT')) AS weak FROM asg GROUP BY contract_id),
  gb AS (SELECT gt.*, dp.n > 1 AS dup, contract_id IN (SELECT contract_id FROM br) AS rw, contract_id IN (SELECT contract_id FROM chk WHERE NOT valid) AS cl, coalesce(ov.n > 1, false) AS ovl, contract_id IN (SELECT contract_id FROM ms) AS cn, coalesce((SELECT count(*) FROM pz WHERE pz.contract_id = gt.contract_id AND synthetic)::DOUBLE / assignments > 0.3, false) AS sd FROM gt LEFT JOIN ov USING (contract_id) LEFT JOIN dp USING (contract_id))"""
PF = "CASE WHEN {} THEN 'FAIL' ELSE 'PASS' END"


@query("a44_assignment_gates", f"WITH {GATES} SELECT contract_id, 'PASS' AS atomic_ids, {PF.format('dup')} AS duplicate_ids, {PF.format('rw')} AS row_integrity, {PF.format('cl')} AS column_bbox, {PF.format('ovl')} AS overlaps, {PF.format('cn')} AS conditions, {PF.format('weak')} AS terminal, {PF.format('sd')} AS synthetic_density, assignments, active, excluded, conditional, undetermined, CAST(round(cf / assignments, 8) AS DOUBLE) AS confidence, CASE WHEN dup OR rw OR cl OR ovl OR cn OR weak OR sd OR undetermined > 0 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status FROM gb")
def a44(spark, sf):
    a = assignments(spark, sf)
    col, row = columns(spark, sf), rows(spark, sf)
    g = S.assignment_gates(a, S.orphan_assignments(a, row), S.column_check(a, col).filter("not valid"), S.missing_conditions(a, zones(spark, sf)), S.promoted_zones(a, col, row))
    return g.withColumn("confidence", F.round("confidence", 8))


@query("a45_package_status", f"""WITH {LNS}, g AS (SELECT contract_id, CASE WHEN size = 13 THEN 'FAIL' WHEN size = 27 THEN 'WARN' ELSE 'PASS' END AS result, CASE WHEN contract_id % 7 = 0 THEN 1 ELSE 0 END AS u, CASE WHEN contract_id % 5 = 0 THEN 1 ELSE 0 END AS k FROM lns), a AS (SELECT contract_id, bool_or(result = 'FAIL') AS f, bool_or(result = 'WARN') AS w, max(u) AS u, max(k) AS k FROM g GROUP BY contract_id)
  SELECT contract_id, CASE WHEN f OR u > 0 THEN 'NEEDS_REVIEW' WHEN k > 0 OR w THEN 'WARN' ELSE 'PASS' END AS status FROM a""")
def a45(spark, sf):
    s, c = F.col("size"), F.col("contract_id")
    g = contract_lines(spark, sf).select("contract_id", F.col("line_no").alias("gate"), F.when(s == 13, "FAIL").when(s == 27, "WARN").otherwise("PASS").alias("result"),
                                                                     F.when(c % 7 == 0, 1).otherwise(0).alias("undetermined"), F.when(c % 5 == 0, 1).otherwise(0).alias("conditional"))
    return S.package_status(g)


@query("g04_expand_spans", f"""WITH {LNS}, c AS (SELECT contract_id, line_no AS cell_no, CAST(line_no // 100 % 40 AS INT) AS ri, size % 6 AS ci, 1 + size % 3 AS rs, 1 + size % 2 AS cs FROM lns), e AS (SELECT contract_id, cell_no, ri, ci, unnest(range(ri, ri + rs)) AS r, cs FROM c), f AS (SELECT contract_id, cell_no, ri, ci, r, unnest(range(ci, ci + cs)) AS c FROM e)
  SELECT contract_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, cell_no, r <> ri OR c <> ci AS carried FROM f QUALIFY row_number() OVER (PARTITION BY contract_id, r, c ORDER BY cell_no, ri, ci) = 1""")
def g04(spark, sf):
    s = F.col("size")
    cells = contract_lines(spark, sf).select("contract_id", F.col("line_no").alias("cell_no"), F.expr("cast(line_no div 100 % 40 as int)").alias("row_index"), (s % 6).alias("col_index"), (1 + s % 3).alias("row_span"), (1 + s % 2).alias("col_span"))
    return S.expand_spans(cells, K)


@query("j45_footnotes", f"""WITH {LNS}, m AS (SELECT contract_id, 'ROW' AS target_kind, CAST(line_no AS VARCHAR) AS target_id, unnest([size % 10, size % 7]) AS marker FROM lns), n AS (SELECT contract_id, size % 10 AS marker, upper(p_name) AS text FROM lns WHERE p_type = 'LARGE') SELECT DISTINCT contract_id, target_kind, target_id, marker, text FROM m JOIN n USING (contract_id, marker)""")
def j45(spark, sf):
    l, s = contract_lines(spark, sf), F.col("size")
    marked = l.select("contract_id", F.lit("ROW").alias("target_kind"), F.col("line_no").cast("string").alias("target_id"), F.array(s % 10, s % 7).alias("markers"))
    return S.footnotes(marked, l.filter("p_type = 'LARGE'").select("contract_id", (s % 10).alias("marker"), F.upper("p_name").alias("text")), K)


@query("j46_scope_rows", f"WITH {LNS}, s AS (SELECT contract_id, line_no AS scope_id, line_no AS a, line_no - size AS b FROM lns WHERE noun = 'plate') SELECT s.contract_id, scope_id, l.line_no AS row_no FROM s JOIN lns l ON l.contract_id = s.contract_id AND l.line_no BETWEEN least(a, b) AND greatest(a, b)")
def j46(spark, sf):
    l = contract_lines(spark, sf)
    scopes = l.filter("noun = 'plate'").select("contract_id", F.col("line_no").alias("scope_id"), F.col("line_no").alias("row_start"), (F.col("line_no") - F.col("size")).alias("row_end"))
    return S.scope_rows(scopes, l.select("contract_id", F.col("line_no").alias("row_no")), K)


RC = f"{CELLS}, rc AS (SELECT CAST(part % 40 AS INT) AS contract_id, CAST(part % 400 AS INT) AS row_id, part AS pos, CASE size % 3 WHEN 0 THEN 'COVERAGE' WHEN 1 THEN 'EVENT' ELSE 'ANNUAL' END AS role, cell AS text FROM cells)"
ASM = f"""{RC}, fc AS (SELECT *, row_number() OVER (PARTITION BY contract_id, row_id, role ORDER BY pos) AS k, CASE WHEN text = '' THEN 'EMPTY' WHEN text = 'SIN TOPE' THEN 'SIN_TOPE' WHEN text = '-' THEN 'UNKNOWN' ELSE 'NUMERIC' END AS st, TRY_CAST(replace(regexp_extract(text, '\\d+(?:,\\d+)?'), ',', '.') AS DOUBLE) AS am FROM rc),
  am0 AS (SELECT contract_id, row_id, max(am) FILTER (WHERE role = 'COVERAGE' AND k = 1 AND am > 0) AS pct, max(CASE WHEN st IN ('NUMERIC', 'SIN_TOPE') THEN st END) FILTER (WHERE role = 'EVENT' AND k = 1) AS event_state, max(CASE WHEN st = 'NUMERIC' THEN am END) FILTER (WHERE role = 'EVENT' AND k = 1) AS event_cap, max(CASE WHEN st IN ('NUMERIC', 'SIN_TOPE') THEN st END) FILTER (WHERE role = 'ANNUAL' AND k = 1) AS annual_state, max(CASE WHEN st = 'NUMERIC' THEN am END) FILTER (WHERE role = 'ANNUAL' AND k = 1) AS annual_cap FROM fc GROUP BY ALL),
  asm AS (SELECT * FROM am0 WHERE pct IS NOT NULL OR event_state IS NOT NULL OR annual_state IS NOT NULL)"""


def role_cells(spark, sf):
    s, p = F.col("size"), F.col("part")
    return _cells(spark, sf).select((p % 40).cast("int").alias("contract_id"), (p % 400).cast("int").alias("row_id"), p.alias("pos"), F.when(s % 3 == 0, "COVERAGE").when(s % 3 == 1, "EVENT").otherwise("ANNUAL").alias("role"), F.col("cell").alias("text"))


@query("a63_rule_assembly", f"WITH {ASM} SELECT * FROM asm")
def a63(spark, sf):
    return S.assemble_rules(role_cells(spark, sf))


@query("a46_reconstructibility", f"""WITH {ASM}, g AS (SELECT r.contract_id, count(*) AS rows, count(a.row_id) AS resolved FROM (SELECT DISTINCT contract_id, row_id FROM rc) r LEFT JOIN (SELECT contract_id, row_id FROM asm WHERE pct IS NOT NULL) a USING (contract_id, row_id) GROUP BY r.contract_id)
  SELECT *, round(resolved::DOUBLE / rows, 2) AS score, CASE WHEN round(resolved::DOUBLE / rows, 2) >= 0.85 THEN 'VERIFIABLE' WHEN round(resolved::DOUBLE / rows, 2) >= 0.45 THEN 'PARCIAL' ELSE 'NO_VERIFICABLE' END AS status FROM g""")
def a46(spark, sf):
    c = role_cells(spark, sf)
    return S.contract_reconstructibility(c.select("contract_id", "row_id").distinct(), S.assemble_rules(c).filter("pct is not null"))


@query("j43_path_providers", f"""WITH {LNS}, r AS (SELECT line_no AS benefit_id, unnest([size % 20, size % 13]) AS path_id FROM lns), p AS (SELECT DISTINCT size % 20 AS path_id, CAST(size % 20 * 5 AS INT) AS pct, unnest([noun, split_part(p_name, ' ', 1)]) AS provider FROM lns) SELECT DISTINCT benefit_id, pct, provider FROM r JOIN p USING (path_id)""")
def j43(spark, sf):
    l, s = contract_lines(spark, sf), F.col("size")
    refs = l.select(F.col("line_no").alias("benefit_id"), F.array(s % 20, s % 13).alias("path_ids"))
    paths = l.select((s % 20).alias("path_id"), (s % 20 * 5).cast("int").alias("pct"), F.array("noun", F.split("p_name", " ").getItem(0)).alias("providers")).distinct()
    return S.resolve_paths(refs, paths)


@query("g03_flatten_tree", f"WITH RECURSIVE {LNS}, n AS (SELECT line_no AS id, CASE WHEN line_no >= 10 THEN line_no // 10 END AS parent FROM lns), t AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.root, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT * FROM t")
def g03(spark, sf):
    nodes = contract_lines(spark, sf).select(F.col("line_no").alias("id"), F.expr("case when line_no >= 10 then line_no div 10 end").alias("parent"))
    return S.flatten_tree(nodes)
