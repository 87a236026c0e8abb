"""Contract rules, caps, networks and code resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ACCOUNTS, DESCRIBED, ITEMS, LINES, LINES_ONLY, PARTS, RULES, any_like, strict, upper
from saldo.catalog.classify import CLASS_SQL, DOMAIN_SQL, FIND, GLOSS_SQL, findings
from saldo.catalog.registry import query
from saldo.functions import lexicon as lx
from saldo.operators import classify as K
from saldo.operators import contracts as C
from saldo.operators import matching as M
from saldo.sources import star

LX = strict("description")
CL = f"""{LINES}, {ACCOUNTS}, {RULES}, sn AS (SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  cl AS (SELECT l.*, contract_id, {DOMAIN_SQL} AS domain, 'CLINICA ' || n_name AS provider_name, priority IN ('1-URGENT', '2-HIGH') AS hospital FROM lines l JOIN accounts a USING (account) JOIN sn ON s_suppkey = provider)"""


def contract_lines(spark, sf):
    lines = star.settlement_lines(spark, sf)
    acc = star.accounts(spark, sf).select("account", "contract_id", F.col("priority").isin("1-URGENT", "2-HIGH").alias("hospital"))
    n = star.table(spark, sf, "nation")
    sup = star.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == n.n_nationkey).select(
        F.col("s_suppkey").alias("provider"), F.concat(F.lit("CLINICA "), "n_name").alias("provider_name"))
    return lines.join(sup, "provider").join(acc, "account").withColumn("domain", K.contract_domain(F.col("code"), F.col("description")))


def chosen_sql(lines: str = "cl", out: str = "ch", domain: str = "domain", hospital: str = "hospital") -> str:
    """Best rule per line: every rule of the domain scored."""
    has = lambda p: f"regexp_matches(nd, '{p}')"
    pref, free = has(C.TRAITS["pref"]), f"({has(C.TRAITS['free'])} AND NOT {has(C.TRAITS['pref'])})"
    who, cl, t = strict("provider_name"), strict("clinic"), strict("text")
    return f"""{out}_s AS (SELECT l.line_id, r.rule_id, r.pct, r.cap_kind, r.cap_value, r.pos AS rpos, count(*) OVER (PARTITION BY line_id) AS n,
    CASE WHEN contains(t, 'medicamento') AND {has(C.TRAITS['drug'])} THEN 500 ELSE 0 END + CASE WHEN contains(t, 'insumo') AND {has(C.TRAITS['supply'])} THEN 500 ELSE 0 END
    + CASE WHEN {pref} THEN CASE modality WHEN 'preferente' THEN 5000 ELSE -1000 END WHEN {free} THEN CASE modality WHEN 'libre_eleccion' THEN 5000 ELSE -1000 END ELSE 0 END
    + CASE WHEN {hospital} THEN CASE WHEN regexp_matches(t, 'hospitalizacion|clinica|pabellon|dia cama|quirurgico') THEN 2000 ELSE 0 END - CASE WHEN regexp_matches(t, 'ambulatorio|visita') THEN 500 ELSE 0 END WHEN contains(t, 'ambulatorio') THEN 500 ELSE 0 END
    + CASE WHEN contains(w, k) OR contains(k, w) THEN 10000 ELSE 0 END AS score
    FROM (SELECT *, {LX} AS nd, {who} AS w FROM {lines}) l JOIN (SELECT *, {t} AS t, {cl} AS k FROM rules) r ON r.contract_id = l.contract_id AND r.domain = {domain if domain.startswith("'") else 'l.' + domain}),
  {out}_b AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, rpos) AS rb, row_number() OVER (PARTITION BY line_id ORDER BY coalesce(pct, 0), rpos) AS rw, max(score) OVER (PARTITION BY line_id) AS top FROM {out}_s),
  {out} AS (SELECT line_id, CASE WHEN n = 1 THEN 'MODALIDAD' WHEN top > 0 THEN 'KEYWORDS' ELSE 'FALLBACK' END AS matched_by, rule_id, pct, cap_kind, cap_value FROM {out}_b WHERE CASE WHEN n = 1 OR top > 0 THEN rb ELSE rw END = 1)"""


def check_sql(src: str, out: str) -> str:
    cap = "CASE cap_kind WHEN 'UF' THEN cap_value * 39750.0 WHEN 'UTM' THEN cap_value * 65000.0 WHEN 'CLP' THEN cap_value WHEN 'VAM' THEN cap_value * 5000.0 WHEN 'AC2' THEN cap_value * 5000.0 END"
    return f"""{out}_c AS (SELECT *, {cap} AS cap, floor(valor * (pct / 100) + 0.5) AS raw FROM {src}),
  {out}_d AS (SELECT *, least(raw, cap) AS exp, valor - least(raw, cap) AS ec, copago - (valor - least(raw, cap)) AS dl, greatest(500, floor(valor * 0.001::DOUBLE + 0.5)) AS tol, rule_id IS NULL OR pct IS NULL AS unk,
    CASE WHEN cap_kind IS NULL OR cap_kind = 'SIN_TOPE_EXPRESO' THEN 'SIN_TOPE' WHEN cap IS NULL THEN 'TOPE_NO_VERIFICABLE' WHEN bonif > cap * 1.02::DOUBLE THEN 'TOPE_EXCEDIDO' ELSE 'TOPE_OK' END AS cs FROM {out}_c),
  {out} AS (SELECT *, CASE WHEN unk THEN 'NO_VERIFICABLE_POR_CONTRATO' WHEN dl > tol THEN 'INFRA_BONIFICACION' WHEN cs = 'TOPE_EXCEDIDO' THEN cs ELSE 'VERIFICABLE_OK' END AS check_state, CASE WHEN NOT unk THEN cs END AS cap_state,
    CASE WHEN NOT unk THEN exp::DOUBLE END AS expected_bonif, CASE WHEN NOT unk THEN ec::DOUBLE END AS expected_copago, CASE WHEN NOT unk THEN greatest(0.0, dl::DOUBLE) END AS excess, CASE WHEN NOT unk THEN tol::DOUBLE END AS tolerance FROM {out}_d)"""


@query("j05_rule_by_affinity", f"WITH {CL}, {chosen_sql()} SELECT cl.line_id, matched_by, rule_id, pct, cap_kind, cap_value FROM cl LEFT JOIN ch USING (line_id)")
def j05(spark, sf):
    return C.choose_rules(contract_lines(spark, sf), star.contract_rules(spark, sf)).select("line_id", "matched_by", "rule_id", "pct", "cap_kind", "cap_value")


CHECKED = f"{CL}, {chosen_sql()}, cc AS (SELECT cl.*, matched_by, rule_id, pct, cap_kind, cap_value FROM cl LEFT JOIN ch USING (line_id)), {check_sql('cc', 'ck')}"


def checked(spark, sf):
    return C.check_payment(C.choose_rules(contract_lines(spark, sf), star.contract_rules(spark, sf)))


@query("p29_payment_check", f"WITH {CHECKED} SELECT line_id, check_state, cap_state, expected_bonif, expected_copago, excess, tolerance FROM ck")
def p29(spark, sf):
    return checked(spark, sf).select("line_id", "check_state", "cap_state", "expected_bonif", "expected_copago", "excess", "tolerance")


ALT = f"""{chosen_sql('cl', 'h1', "'HONORARIOS'", 'true')}, h1c AS (SELECT cl.*, rule_id, pct, cap_kind, cap_value FROM cl JOIN h1 USING (line_id)), {check_sql('h1c', 'k1')},
  {chosen_sql('cl', 'h2', "'HOSPITALIZACION'", 'true')}, h2c AS (SELECT cl.*, rule_id, pct, cap_kind, cap_value FROM cl JOIN h2 USING (line_id)), {check_sql('h2c', 'k2')},
  al AS (SELECT cl.line_id, CASE WHEN k1.line_id IS NOT NULL AND k1.check_state <> 'NO_VERIFICABLE_POR_CONTRATO' THEN 'HONORARIOS' WHEN k2.line_id IS NOT NULL AND k2.check_state <> 'NO_VERIFICABLE_POR_CONTRATO' THEN 'HOSPITALIZACION' END AS alt_domain,
    CASE WHEN k1.check_state <> 'NO_VERIFICABLE_POR_CONTRATO' THEN k1.pct ELSE k2.pct END AS alt_pct, CASE WHEN k1.check_state <> 'NO_VERIFICABLE_POR_CONTRATO' THEN k1.expected_copago ELSE k2.expected_copago END AS alt_copago
    FROM cl LEFT JOIN k1 USING (line_id) LEFT JOIN k2 ON k2.line_id = cl.line_id)"""


@query("j06_alternative_domain", f"WITH {CL}, {ALT} SELECT * FROM al")
def j06(spark, sf):
    return C.alternative_check(contract_lines(spark, sf), star.contract_rules(spark, sf))


@query("p30_rule_exists", f"WITH {CL} SELECT line_id, EXISTS (SELECT 1 FROM rules r WHERE r.contract_id = cl.contract_id AND r.domain = cl.domain) AS has_rule FROM cl")
def p30(spark, sf):
    return C.rule_exists(contract_lines(spark, sf), star.contract_rules(spark, sf))


@query("a48_best_rules", f"""WITH {RULES}, r AS (SELECT *, cap_value IS NOT NULL OR cap_kind = 'SIN_TOPE_EXPRESO' AS capped FROM rules), p AS (SELECT *, row_number() OVER (PARTITION BY contract_id, domain, modality ORDER BY pct IS NULL, CASE WHEN pct IS NULL THEN pos ELSE 0 END, NOT capped, -coalesce(pct, 0), pos) AS k FROM r),
  b AS (SELECT contract_id, domain, modality, arg_min((cap_kind, cap_value), pos) AS lent FROM r WHERE capped AND pct IS NULL GROUP BY ALL)
  SELECT p.contract_id, p.domain, p.modality, rule_id, pct, CASE WHEN NOT capped AND lent IS NOT NULL THEN lent[1] ELSE cap_kind END AS cap_kind, CASE WHEN NOT capped AND lent IS NOT NULL THEN lent[2] ELSE cap_value END AS cap_value FROM p LEFT JOIN b USING (contract_id, domain, modality) WHERE k = 1""")
def a48(spark, sf):
    return C.best_rules(star.contract_rules(spark, sf))


BEN = f"{PARTS}, ben AS (SELECT part % 50 AS contract_id, section AS benefit_class, description AS benefit, CAST(size AS DOUBLE) AS pct, 'UF' AS cap_kind, CAST(size % 7 AS DOUBLE) AS cap_value FROM parts)"


@query("a49_merge_items", f"WITH {BEN} SELECT DISTINCT contract_id, upper(benefit_class) AS benefit_class, {strict('benefit')} AS benefit, pct, cap_kind, cap_value FROM ben")
def a49(spark, sf):
    s = F.col("size")
    b = star.parts(spark, sf).select((F.col("part") % 50).alias("contract_id"), F.col("section").alias("benefit_class"), F.col("description").alias("benefit"), s.cast("double").alias("pct"),
                                     F.lit("UF").alias("cap_kind"), (s % 7).cast("double").alias("cap_value"))
    return C.merge_items(b)


@query("j14_provider_network", """SELECT s_suppkey AS provider, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE contains(upper(s_name || ' ' || s_nationkey || ' NATION_' || s_nationkey), upper(n_name)) AND n_regionkey = 2) THEN 'PREFERENTE' ELSE 'LIBRE_ELECCION' END AS network FROM supplier""")
def j14(spark, sf):
    p = star.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("provider"), F.concat("s_name", F.lit(" "), "s_nationkey", F.lit(" NATION_"), "s_nationkey").alias("name"))
    return C.provider_network(p, star.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_name").alias("alias")))


@query("j15_coverage_factor", f"""WITH {RULES}, t AS (SELECT contract_id, pct, pos, CASE WHEN contains(domain, 'HONORARIOS') THEN 0 WHEN contains(domain, 'QUIRURGICO') THEN 2 END AS t, CASE WHEN upper(modality) = 'LIBRE_ELECCION' THEN 0 ELSE 1 END AS m FROM rules), k AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY t, m, pos) AS r FROM t WHERE t IS NOT NULL AND pct > 0)
  SELECT c.contract_id, coalesce(CASE WHEN pct > 1 THEN pct / 100 ELSE pct END, 0.7::DOUBLE) AS factor FROM (SELECT DISTINCT contract_id FROM rules) c LEFT JOIN k ON k.contract_id = c.contract_id AND r = 1""")
def j15(spark, sf):
    return C.coverage_factor(star.contract_rules(spark, sf).withColumn("benefit", F.col("domain")))


CAPRULES = f"{PARTS}, cr AS (SELECT DISTINCT substr(code, 1, 2) || ', ' || substr(code, 1, 4) AS triggers, CASE WHEN CAST(substr(code, 3, 2) AS INT) % 2 = 0 THEN 'preferente' ELSE 'libre_eleccion' END AS modality, CAST(substr(code, 1, 4) AS BIGINT) AS pos, 'C' || substr(code, 1, 4) AS rule_id, CAST(substr(code, 3, 2) AS DOUBLE) AS cap_value FROM parts)"


@query("j16_cap_rule_by_code", f"""WITH {CAPRULES}, t AS (SELECT *, unnest(string_split(triggers, ', ')) AS trig FROM cr), it AS (SELECT DISTINCT code, 'preferente' AS modality FROM parts),
  j AS (SELECT it.code, it.modality, rule_id, cap_value, row_number() OVER (PARTITION BY it.code ORDER BY t.modality <> it.modality, pos) AS r FROM it JOIN t ON starts_with(it.code, trig)) SELECT code, modality, rule_id, cap_value FROM j WHERE r = 1""")
def j16(spark, sf):
    p = star.parts(spark, sf)
    two, four = F.substring("code", 1, 2), F.substring("code", 1, 4)
    size = F.substring("code", 3, 2).cast("int")
    rules = p.select(F.concat(two, F.lit(", "), four).alias("triggers"), F.when(size % 2 == 0, "preferente").otherwise("libre_eleccion").alias("modality"), four.cast("long").alias("pos"),
                     F.concat(F.lit("C"), four).alias("rule_id"), size.cast("double").alias("cap_value")).distinct()
    return C.cap_rules_by_code(p.select("code", F.lit("preferente").alias("modality")).distinct(), rules)


FEES = f"""{LINES}, fe AS (SELECT line_id, bonif, CASE code WHEN '1103057' THEN 1.2::DOUBLE WHEN '3101001' THEN 3.0 END AS factor, CASE WHEN provider % 4 = 0 THEN NULL ELSE CAST(bonif // 2 AS DOUBLE) END AS unit_value, CASE WHEN provider % 3 = 0 THEN 1.0::DOUBLE ELSE 0.5 END AS coverage, CASE WHEN provider % 5 = 0 THEN 'BAJA' ELSE 'ALTA' END AS confidence FROM lines)"""


@query("p31_fee_cap_check", f"""WITH {FEES}, t AS (SELECT *, unit_value * factor * coverage AS theory FROM fe), v AS (SELECT *, CASE WHEN factor IS NULL THEN 'SIN_TOPE' WHEN confidence = 'BAJA' OR unit_value IS NULL THEN 'NO_VERIFICABLE' WHEN abs(bonif - theory) <= 1.5 THEN 'CUMPLE' WHEN bonif > theory + 1.5 THEN 'CUMPLE_EXCEDE' ELSE 'DISCREPANCIA' END AS verdict FROM t)
  SELECT line_id, theory, verdict, factor IS NOT NULL AS applies, verdict IN ('CUMPLE', 'CUMPLE_EXCEDE') AS met FROM v""")
def p31(spark, sf):
    p = F.col("provider")
    fees = star.settlement_lines(spark, sf).select(
        "line_id", "bonif", K.lookup(F.col("code"), {"1103057": 1.2, "3101001": 3.0}, None).alias("factor"), F.when(p % 4 != 0, F.expr("bonif div 2").cast("double")).alias("unit_value"),
        F.when(p % 3 == 0, 1.0).otherwise(0.5).alias("coverage"), F.when(p % 5 == 0, "BAJA").otherwise("ALTA").alias("confidence"))
    return C.fee_cap_check(fees).select("line_id", "theory", "verdict", "applies", "met")


@query("j17_resolve_code", f"WITH {PARTS}, s AS (SELECT code, arg_min(description, part) AS t FROM parts WHERE p_type <> 'SMALL' GROUP BY code) SELECT p.part, p.code, t AS schedule_text FROM parts p LEFT JOIN s USING (code)")
def j17(spark, sf):
    p = star.parts(spark, sf)
    s = p.filter("p_type <> 'SMALL'").select("code", "description", F.col("part").alias("pos"))
    dashed = F.concat(F.substring("code", 1, 2), F.lit("-"), F.substring("code", 3, 9))
    return C.resolve_code(p.select("part", dashed.alias("code")), s).select("part", "code", "schedule_text")


# Fee schedule: one entry per distinct item text; queries in every tier.
SCHED = f"""{PARTS}, sc AS (SELECT description, min(code) AS code, min(part) AS pos FROM parts WHERE p_name NOT LIKE 'small%' GROUP BY description),
  tx AS (SELECT DISTINCT CASE part % 4 WHEN 0 THEN 'glosa ' || substr(code, 1, 2) || ' ' || substr(code, 3, 2) || ' ' || substr(code, 5, 3) WHEN 1 THEN lower(description) WHEN 2 THEN substr(description, 3, 14) ELSE 'CONTROL DE ' || description || ' (x)' END AS text FROM parts)"""


def schedule_and_texts(spark, sf):
    p = star.parts(spark, sf)
    s = p.filter("p_name not like 'small%'").groupBy("description").agg(F.min("code").alias("code"), F.min("part").alias("pos"))
    k, c, d = F.col("part") % 4, F.col("code"), F.col("description")
    spaced = F.concat(F.lit("glosa "), F.substring(c, 1, 2), F.lit(" "), F.substring(c, 3, 2), F.lit(" "), F.substring(c, 5, 3))
    t = p.select(F.when(k == 0, spaced).when(k == 1, F.lower(d)).when(k == 2, F.substring(d, 3, 14)).otherwise(F.concat(F.lit("CONTROL DE "), d, F.lit(" (x)"))).alias("text")).distinct()
    return s, t


@query("j18_resolve_text", f"""WITH {SCHED}, q AS (SELECT text, replace(regexp_extract(text, '\\d{{2}}\\s?\\d{{2}}\\s?\\d{{3}}'), ' ', '') AS code, {upper("regexp_replace(split_part(text, '(', 1), '\\b\\d{{6,8}}\\b', '', 'g')")} AS q FROM tx), s AS (SELECT code AS sc, pos, {upper('description')} AS s FROM sc),
  w AS (SELECT text, q, list_distinct(list_filter(string_split(q, ' '), lambda x: length(x) > 3)) AS qw FROM q WHERE length(q) >= 3), sw AS (SELECT *, list_distinct(list_filter(string_split(s, ' '), lambda x: length(x) > 3)) AS ws FROM s),
  c AS (SELECT text, 0 AS tier, 1.0::DOUBLE AS sh, pos, sc FROM q JOIN s ON q.code = sc AND q.code <> '' UNION ALL SELECT text, 1, 1.0, pos, sc FROM w JOIN sw ON q = s UNION ALL SELECT text, 2, 1.0, pos, sc FROM w JOIN sw ON contains(s, q) OR (length(s) > 5 AND contains(q, s))
  UNION ALL SELECT text, 3, len(list_intersect(qw, ws))::DOUBLE / len(qw), pos, sc FROM w JOIN sw ON len(qw) > 0 AND len(list_intersect(qw, ws))::DOUBLE / len(qw) >= 0.6)
  SELECT text, sc AS code, tier FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY tier, -sh, pos, sc) = 1""")
def j18(spark, sf):
    s, t = schedule_and_texts(spark, sf)
    return C.resolve_text(t, s)


@query("j29_enrich_descriptions", f"""WITH {ITEMS}, {LINES_ONLY}, bc AS (SELECT account, code, arg_max(description, pos) AS d FROM items GROUP BY ALL), bp AS (SELECT account, copago, arg_max(description, pos) AS d FROM items GROUP BY ALL)
  SELECT l.account, line_id, CASE WHEN regexp_matches(l.description, 'MEDICAMENTO|INSUMO|MATERIAL') AND coalesce(bc.d, bp.d) IS NOT NULL THEN coalesce(bc.d, bp.d) || ' (PAM: ' || l.description || ')' ELSE l.description END AS enriched FROM lines l LEFT JOIN bc USING (account, code) LEFT JOIN bp ON bp.account = l.account AND bp.copago = l.copago""")
def j29(spark, sf):
    return C.enrich_descriptions(star.settlement_lines(spark, sf), star.bill_items(spark, sf)).select("account", "line_id", "enriched")


ANCH = "an AS (SELECT account, CASE folio WHEN 'NF' THEN '1103057' WHEN 'NO' THEN '1802081' WHEN 'AF' THEN '1801001' ELSE '9' END AS code, bonif FROM charges)"
OFF = """iv AS (SELECT account, code, CASE code WHEN '1103057' THEN 'AC2' ELSE 'VA' END AS unit, floor(bonif / CASE code WHEN '1103057' THEN 1.2::DOUBLE WHEN '1802081' THEN 6.0 ELSE 3.0 END + 0.5) AS v FROM an WHERE code <> '9' AND bonif > 0),
  pu AS (SELECT account, unit, avg(v) AS m, min(v) AS lo, max(v) AS hi, count(*) AS n FROM iv GROUP BY ALL), off AS (SELECT account, bool_or(n >= 2 AND greatest(hi - m, m - lo) / m > 0.05) OR count(*) > 1 AS contradictory FROM pu GROUP BY account)"""


def anchors(spark, sf):
    code = K.lookup(F.col("folio"), {"NF": "1103057", "NO": "1802081", "AF": "1801001"}, "9")
    return star.charges(spark, sf).select("account", code.alias("code"), "bonif")


@query("a22_unit_value", f"""WITH {LINES}, {ANCH}, {OFF}, g AS (SELECT account, avg(v) AS mean, count(DISTINCT code) AS ind FROM iv GROUP BY account), o AS (SELECT account, count(*) AS n, count(*) FILTER (WHERE folio LIKE 'R%') AS vague, bool_or(folio LIKE 'R%' AND valor > 9000000) AS blk FROM lines GROUP BY account),
  j AS (SELECT account, mean, ind, vague::DOUBLE / greatest(n, 1) AS sh, vague::DOUBLE / greatest(n, 1) > 0.35 OR blk AS opq, coalesce(contradictory, false) AS bad, mean IS NOT NULL AND NOT coalesce(contradictory, false) AS fnd FROM o LEFT JOIN g USING (account) LEFT JOIN off USING (account))
  SELECT account, CAST(CASE WHEN fnd THEN floor(mean + 0.5) ELSE 40500 END AS BIGINT) AS unit_value, CASE WHEN fnd AND ind >= 2 THEN 'ALTA' WHEN fnd THEN 'MEDIA' ELSE 'BAJA' END AS confidence, CASE WHEN opq THEN 'NO_VERIFICABLE_POR_OPACIDAD' WHEN bad OR NOT fnd THEN 'NO_VERIFICABLE_POR_CONTRATO' ELSE 'VERIFICABLE' END AS state,
  CASE WHEN opq THEN greatest(0.1::DOUBLE, 0.5 - sh) WHEN bad THEN 0.2 WHEN fnd AND ind >= 2 THEN 1.0 WHEN fnd THEN 0.75 ELSE 0.3 END::DOUBLE AS trust FROM j""")
def a22(spark, sf):
    vague = F.col("folio").startswith("R")
    o = star.settlement_lines(spark, sf).groupBy("account").agg(F.count("*").alias("lines"), F.count_if(vague).alias("vague"), F.bool_or(vague & (F.col("valor") > 9000000)).alias("opaque_block"))
    return C.infer_unit_value(anchors(spark, sf), o)


@query("a23_anchor_contradictions", f"WITH {LINES}, {ANCH}, {OFF} SELECT * FROM off")
def a23(spark, sf):
    a = anchors(spark, sf).filter("code <> '9' and bonif > 0")
    f = K.lookup(F.col("code"), lx.FEE_FACTORS, None)
    return C.contradictions(a.select("account", "code", F.when(F.col("code") == "1103057", "AC2").otherwise("VA").alias("unit"), F.floor(F.col("bonif") / f + 0.5).alias("implied")))


@query("a52_concepts", f"""WITH {PARTS}, l AS (SELECT part % 50 AS contract_id, part AS pos, 'L' || part AS line_id, upper(split_part(p_name, ' ', 2)) || ' (' || (part % 3) || ')' AS name, CAST(size AS DOUBLE) AS pct, section = 'PABELLON' AS locked, section = '' AS empty_cell, section = 'FARMACIA' AS no_cap FROM parts)
  SELECT contract_id, trim(regexp_replace(regexp_replace(name, '\\(\\d+\\)', '', 'g'), '\\s+', ' ', 'g')) AS concept, arg_min(line_id, pos) AS "primary", arg_min(pct, pos) AS pct, count(*) AS lines, bool_or(locked) AS locked, bool_or(empty_cell) AS void, bool_or(no_cap) AS uncapped FROM l GROUP BY ALL""")
def a52(spark, sf):
    s = F.col("section")
    l = star.parts(spark, sf).select((F.col("part") % 50).alias("contract_id"), F.col("part").alias("pos"), F.concat(F.lit("L"), F.col("part").cast("string")).alias("line_id"),
                                     F.concat(F.upper(F.split("p_name", " ").getItem(1)), F.lit(" ("), (F.col("part") % 3).cast("string"), F.lit(")")).alias("name"), F.col("size").cast("double").alias("pct"),
                                     (s == "PABELLON").alias("locked"), (s == "").alias("empty_cell"), (s == "FARMACIA").alias("no_cap"))
    return C.concepts(l)


@query("p50_option_issues", f"""WITH {PARTS}, o AS (SELECT part % 100 AS row_id, part AS option_id, CASE WHEN size % 3 = 0 THEN 'libre_eleccion' ELSE 'preferente' END AS modality, CASE size % 4 WHEN 0 THEN 80 WHEN 1 THEN 90 WHEN 2 THEN NULL ELSE 70 END AS pct, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS providers, size = 50 AS cut, size % 5 AS ce, size % 7 AS ca FROM parts),
  e AS (SELECT DISTINCT row_id, pct, unnest(providers) AS p FROM o WHERE modality = 'preferente' AND pct IN (80, 90)), m AS (SELECT DISTINCT row_id FROM (SELECT row_id, p FROM e GROUP BY ALL HAVING count(*) > 1)),
  g AS (SELECT row_id, count(*) FILTER (WHERE modality = 'preferente' AND pct IS NULL) AS no_percent, bool_or(cut) AND bool_or(modality = 'preferente') AS broken_cut, count(*) FILTER (WHERE ce = ca) AS collapsed FROM o GROUP BY row_id)
  SELECT g.row_id, m.row_id IS NOT NULL AS mixed, no_percent, broken_cut, collapsed, least(10.0, greatest(0.0, 10 - ((m.row_id IS NOT NULL)::INT + broken_cut::INT) * 3.5::DOUBLE - collapsed * 2.0::DOUBLE - no_percent * 0.8::DOUBLE)) AS score FROM g LEFT JOIN m USING (row_id)""")
def p50(spark, sf):
    s = F.col("size")
    w = F.split("p_name", " ")
    o = star.parts(spark, sf).select((F.col("part") % 100).alias("row_id"), F.col("part").alias("option_id"), F.when(s % 3 == 0, "libre_eleccion").otherwise("preferente").alias("modality"),
                                     F.when(s % 4 == 0, 80).when(s % 4 == 1, 90).when(s % 4 == 3, 70).alias("pct"), w.alias("providers"), (s == 50).alias("cut"), (s % 5).alias("cap_event"), (s % 7).alias("cap_annual"))
    return C.option_issues(o)


RAW_BENEFITS = """raw AS (SELECT part % 50 AS contract_id, part AS pos, section AS category, description AS benefit, size FROM parts)"""


def raw_benefits(spark, sf):
    s = F.col("size")
    none = F.lit(None).cast("string")
    mod = lambda kind, pct, cap, annual, copay: F.struct(F.lit(kind).alias("kind"), pct.cast("double").alias("pct"), cap.alias("cap"), annual.alias("annual_cap"), copay.alias("copay"))
    txt = s.cast("string")
    m = F.array(mod("PREFERENTE", s, F.concat(txt, F.lit(" UF")), F.when(s % 2 == 0, F.concat(txt, F.lit("0 UF"))), F.when(s % 5 == 0, F.concat(txt, F.lit(" UF")))),
                mod("LIBRE_ELECCION", s / 2, F.when(s % 3 == 0, "SIN TOPE").otherwise("-"), none, none))
    return star.parts(spark, sf).select((F.col("part") % 50).alias("contract_id"), F.col("part").alias("pos"), F.col("section").alias("category"), F.col("description").alias("benefit"), m.alias("modalities"))


@query("s05_canonical_caps", f"""WITH {PARTS}, {RAW_BENEFITS}, sc AS (SELECT *, CASE WHEN regexp_matches({strict("category || ' ' || benefit")}, 'hosp|dia cama|pabellon|quirurg') THEN 'hospitalario' WHEN regexp_matches({strict("category || ' ' || benefit")}, 'amb|consulta|examen|laborat') THEN 'ambulatorio' WHEN regexp_matches({strict("category || ' ' || benefit")}, 'restringida|libre|extra') THEN 'mixto' ELSE 'desconocido' END AS scope FROM raw),
  m AS (SELECT contract_id, pos, benefit, scope, 'preferente' AS modality, 'por_evento' AS applies, size || ' UF' AS t FROM sc UNION ALL SELECT contract_id, pos, benefit, scope, 'libre_eleccion', 'por_evento', CASE WHEN size % 3 = 0 THEN 'SIN TOPE' ELSE '-' END FROM sc
   UNION ALL SELECT contract_id, pos, benefit, scope, 'preferente', 'anual', CASE WHEN size % 2 = 0 THEN size || '0 UF' ELSE 'SIN TOPE' END FROM sc UNION ALL SELECT contract_id, pos, benefit, scope, 'libre_eleccion', 'anual', 'SIN TOPE' FROM sc)
  SELECT contract_id, pos, benefit, scope, modality, applies, CASE t WHEN '-' THEN 'NO_ENCONTRADO' WHEN 'SIN TOPE' THEN 'SIN_TOPE_EXPLICITO' ELSE 'NUMERICO' END AS kind, CASE WHEN t LIKE '%UF' THEN 'UF' END AS unit, TRY_CAST(split_part(t, ' ', 1) AS DOUBLE) AS value, CASE t WHEN '-' THEN 'CELDA_VACIA_OCR' WHEN 'SIN TOPE' THEN 'SIN_TOPE_EXPRESO_EN_CONTRATO' END AS reason FROM m""")
def s05(spark, sf):
    return C.canonical_coverages(raw_benefits(spark, sf))["caps"]


@query("s05_canonical_coverages", f"""WITH {PARTS}, {RAW_BENEFITS} SELECT contract_id, pos, benefit, 'preferente' AS modality, CAST(size AS DOUBLE) AS pct FROM raw UNION ALL SELECT contract_id, pos, benefit, 'libre_eleccion', size / 2.0::DOUBLE FROM raw""")
def s05b(spark, sf):
    return C.canonical_coverages(raw_benefits(spark, sf))["coverages"].drop("scope")


@query("s05_canonical_copays", f"WITH {PARTS}, {RAW_BENEFITS} SELECT contract_id, pos, benefit, 'preferente' AS modality, CAST(size AS DOUBLE) AS value, 'UF' AS unit FROM raw WHERE size % 5 = 0")
def s05c(spark, sf):
    return C.canonical_coverages(raw_benefits(spark, sf))["copays"]


@query("s05_rule_texts", f"""WITH {PARTS}, t AS (SELECT part % 50 AS contract_id, part AS pos, CASE size % 3 WHEN 0 THEN 'Exclusiones' WHEN 1 THEN 'Deducible' ELSE 'Tope' END AS category, size FROM parts)
  SELECT contract_id, pos, CASE category WHEN 'Exclusiones' THEN 'EXCLUSION' WHEN 'Deducible' THEN 'DEDUCIBLE' ELSE 'REGLA' END AS kind, CASE WHEN category = 'Deducible' THEN CAST(size AS DOUBLE) + 0.5 END AS value, CASE WHEN category = 'Deducible' THEN CASE WHEN size % 2 = 0 THEN 'anual' ELSE 'desconocido' END END AS applies FROM t""")
def s05d(spark, sf):
    s = F.col("size")
    t = star.parts(spark, sf).select((F.col("part") % 50).alias("contract_id"), F.col("part").alias("pos"), F.when(s % 3 == 0, "Exclusiones").when(s % 3 == 1, "Deducible").otherwise("Tope").alias("category"),
                                     F.concat(F.lit("Monto de "), s.cast("string"), F.lit(",5 UF"), F.when(s % 2 == 0, " anual").otherwise("")).alias("text"))
    return C.rule_texts(t)


# Facts of the matched set of a line: the items the insurer paid together.
FACTS = f"""fac AS (SELECT account || ':' || folio AS line_id, count(*) AS n_items, sum(total) AS msum, {', '.join(f'bool_or({CLASS_SQL[k]}) AS any_{k}' for k in ('eligible_strong', 'eligible_weak', 'belongs', 'surgical_drug', 'clinical_act', 'amenity'))},
  bool_and({CLASS_SQL['amenity']}) AS all_amenity, count(*) FILTER (WHERE {CLASS_SQL['amenity']})::DOUBLE / count(*) AS am, count(*) FILTER (WHERE {CLASS_SQL['admin']})::DOUBLE / count(*) AS ad FROM (SELECT *, {strict('description')} AS nd, {strict('section')} AS ns FROM described) GROUP BY account, folio),
  ev AS (SELECT account, bool_or({any_like("lower(section || ' ' || description)", lx.SURGERY_TEXT + lx.ANESTHESIA_TEXT)}) AS hs, bool_or({any_like("lower(section || ' ' || description)", lx.STAY_TEXT)}) AS hd FROM described GROUP BY account)"""
MOTOR = f"""{CHECKED}, {ALT}, {PARTS}, described AS (SELECT * FROM charges JOIN parts USING (part)), {FACTS},
  mx AS (SELECT ck.*, {LX} AS nd, n_items, msum, any_eligible_strong AS st, any_eligible_weak AS wk, any_belongs AS bl, any_surgical_drug AS sd, any_clinical_act AS ca, any_amenity AS aa, all_amenity, am, ad, hs, hd, alt_domain, alt_pct, alt_copago,
    CASE WHEN n_items = 1 THEN 'TRACE_OK' WHEN n_items <= 2 THEN 'TRACE_WEAK' ELSE 'TRACE_NONE' END AS lvl FROM ck JOIN fac USING (line_id) JOIN ev USING (account) JOIN al USING (line_id)),
  my AS (SELECT *, code IN ('3201001', '3201002') AS nc, code IN ('3101002', '3201001', '3101001', '3201002', '3000000') OR {any_like('nd', lx.GENERIC_GLOSS)} AS gen, bonif = 0 AND abs(copago - valor) < 2 AS reb, hs OR hd AS evt FROM mx),
  mz AS (SELECT *, CASE WHEN copago = 0 THEN 0 WHEN (nc OR contains(nd, 'no contemplada en el arancel') OR contains(nd, 'no cubierto por el plan')) AND n_items = 1 AND NOT aa AND (code <> '3201001' OR ca) THEN 1
    WHEN {any_like('nd', lx.NURSING_ACT)} AND NOT contains(nd, 'pabellon') AND NOT contains(nd, 'dia cama') THEN 1 WHEN bonif = 0 AND copago > 0 AND code NOT IN ('3101001', '3101002') AND NOT nc AND NOT gen THEN 1
    WHEN reb AND code IN ('3101001', '3101002', '3201001', '3201002', '3000000') AND lvl <> 'TRACE_NONE' AND NOT all_amenity AND ((st AND evt) OR (sd AND hs) OR (wk AND bl AND evt)) THEN 2
    WHEN reb AND (nc OR regexp_matches(nd, 'no cubierto|insumos|gasto|otros|materiales|no gasto medico')) AND NOT (st OR (wk AND bl) OR sd) THEN 3
    WHEN evt AND domain IN ('CONSULTA', 'EXAMENES', 'KINESIOLOGIA', 'TRASLADOS', 'PROTESIS_ORTESIS') AND copago > coalesce(tolerance, 1000) AND alt_domain IS NOT NULL AND (coalesce(alt_pct, 0) > coalesce(pct, 0) OR (check_state = 'INFRA_BONIFICACION' AND coalesce(alt_pct, 0) >= coalesce(pct, 0))) THEN 4
    WHEN lvl = 'TRACE_OK' AND abs(msum - valor) < 2 AND check_state = 'VERIFICABLE_OK' THEN 5 WHEN gen OR abs(msum - valor) < 100 THEN 6 WHEN check_state = 'INFRA_BONIFICACION' AND excess > 0 THEN 7 WHEN check_state = 'TOPE_EXCEDIDO' THEN 8 ELSE 9 END AS c FROM my),
  aud AS (SELECT account, line_id, copago, CASE c WHEN 0 THEN 'CORRECTO' WHEN 5 THEN 'CORRECTO' WHEN 1 THEN 'NO_ARANCELABLE' WHEN 2 THEN 'FRAGMENTACION_ESTRUCTURAL' WHEN 3 THEN 'FRAGMENTACION_ESTRUCTURAL' WHEN 4 THEN 'DISCUSION_TECNICA' WHEN 6 THEN 'FRAGMENTACION_ESTRUCTURAL' WHEN 7 THEN 'INFRA_BONIFICACION' WHEN 8 THEN 'DISCUSION_TECNICA' ELSE 'FRAGMENTACION_ESTRUCTURAL' END AS level,
    CASE c WHEN 0 THEN 'NA' WHEN 5 THEN 'NA' WHEN 1 THEN 'M1' WHEN 2 THEN 'M2' WHEN 3 THEN 'M3' WHEN 4 THEN 'M4' WHEN 6 THEN 'M3' WHEN 7 THEN 'M5' WHEN 8 THEN 'M5' ELSE 'M4' END AS motor, CASE WHEN c = 3 THEN CASE WHEN am >= 0.6 THEN 'TGE_C' WHEN ad >= 0.6 THEN 'TGE_D' WHEN am >= 0.3 THEN 'TGE_E' ELSE 'TGE_A' END ELSE 'NONE' END AS gloss_type,
    CASE WHEN c IN (0, 5) THEN 0 WHEN c = 4 THEN least(copago, CASE WHEN coalesce(expected_copago, copago) - coalesce(alt_copago, 0) = 0 THEN copago ELSE coalesce(expected_copago, copago) - coalesce(alt_copago, 0) END) WHEN c = 7 THEN excess ELSE copago END::DOUBLE AS impact, coalesce(excess, 0)::BIGINT AS excess,
    CASE WHEN copago = 0 AND bonif > 0 THEN 0 ELSE CASE WHEN (code IN ('3101002', '3201001', '3101001', '3201002', '3000000') OR contains(nd, 'no cubierto')) AND lvl <> 'TRACE_OK' THEN 25 ELSE 0 END + CASE WHEN regexp_matches(nd, 'no cubierto|insumos|gasto') THEN 20 ELSE 0 END + CASE WHEN bonif = 0 AND copago > 0 THEN 15 ELSE 0 END + CASE WHEN lvl = 'TRACE_NONE' THEN 15 ELSE 0 END END AS score FROM mz)"""


def audited(spark, sf):
    """Lines through contract check, alternative domain, matched-set facts and motors."""
    from saldo.plans import matcher
    lines, rules, items = contract_lines(spark, sf), star.contract_rules(spark, sf), star.described(spark, sf)
    members = items.withColumn("line_id", F.concat_ws(":", F.col("account").cast("string"), "folio"))
    n = F.col("n_items")
    level = F.when(n == 1, "TRACE_OK").when(n <= 2, "TRACE_WEAK").otherwise("TRACE_NONE")
    return matcher.audit_lines(lines, rules, members, M.event_model(items), level)


@query("p25_motors", f"WITH {MOTOR} SELECT line_id, level, motor, gloss_type, impact FROM aud")
def p25(spark, sf):
    return audited(spark, sf).select("line_id", "level", "motor", "gloss_type", "impact")


@query("a12_audit_summary", f"""WITH {MOTOR}, g AS (SELECT account, CAST(sum(copago) AS BIGINT) AS copago, CAST(coalesce(sum(copago) FILTER (WHERE fi), 0) AS BIGINT) AS impact, count(*) FILTER (WHERE fi AND motor = 'M1') AS m1, count(*) FILTER (WHERE fi AND motor = 'M2') AS m2, CAST(coalesce(sum(copago) FILTER (WHERE fi AND motor = 'M3'), 0) AS BIGINT) AS m3_copago,
  count(*) FILTER (WHERE fi AND motor = 'M5') AS m5, CAST(coalesce(sum(excess) FILTER (WHERE fi AND motor = 'M5'), 0) AS BIGINT) AS m5_excess, max(score) AS max_score FROM (SELECT *, level <> 'CORRECTO' OR score >= 40 AS fi FROM aud) GROUP BY account), s AS (SELECT *, CASE WHEN copago > 0 THEN m3_copago::DOUBLE / copago ELSE 0 END AS m3_share FROM g)
  SELECT *, m1 >= 3 OR m2 >= 5 OR m5 >= 3 OR m3_share >= 0.1 AS systemic FROM s""")
def a12(spark, sf):
    from saldo.operators import reports
    return reports.audit_summary(audited(spark, sf))


@query("a13_finding_matrix", f"WITH {MOTOR} SELECT account, line_id, level, motor, copago, score FROM aud WHERE level <> 'CORRECTO' OR score >= 40")
def a13(spark, sf):
    from saldo.operators import reports
    return reports.finding_matrix(audited(spark, sf))


SIM_MAP = {"PABELLON": ["R_GEAR", "R_ROD"], "HOSPITALIZACION": ["R_PLATE"], "FARMACIA": ["R_BOLT"]}
ASG = """asg AS (SELECT part % 30 AS contract_id, part AS pos, 'R_' || upper(split_part(p_name, ' ', 2)) AS row_id, CASE WHEN size % 4 = 0 THEN 'Sin Tope' ELSE CAST(size AS VARCHAR) END AS value, CASE WHEN size % 3 = 0 THEN '%' WHEN size % 3 = 1 THEN 'UF' ELSE 'AC2' END AS unit FROM parts)"""


def assignments(spark, sf):
    s = F.col("size")
    return star.parts(spark, sf).select((F.col("part") % 30).alias("contract_id"), F.col("part").alias("pos"), F.concat(F.lit("R_"), F.upper(F.split("p_name", " ").getItem(1))).alias("row_id"),
                                        F.when(s % 4 == 0, "Sin Tope").otherwise(s.cast("string")).alias("value"), F.when(s % 3 == 0, "%").when(s % 3 == 1, "UF").otherwise("AC2").alias("unit"))


@query("a42_coverage_simulation", f"""WITH {DESCRIBED}, {ASG}, sec AS (SELECT section, sum(total) AS total FROM described GROUP BY section), mp AS (SELECT * FROM (VALUES ('PABELLON', 'R_GEAR'), ('PABELLON', 'R_ROD'), ('HOSPITALIZACION', 'R_PLATE'), ('FARMACIA', 'R_BOLT')) t(section, row_id)),
  f AS (SELECT contract_id, section, total, arg_min((value, unit), pos) AS a FROM asg JOIN mp USING (row_id) JOIN sec USING (section) GROUP BY ALL), c AS (SELECT contract_id, sum(total * CASE WHEN contains(lower(a[1]), 'sin tope') THEN 1.0 WHEN a[2] = '%' THEN CAST(a[1] AS DOUBLE) / 100 ELSE 0.5 END) AS covered FROM f GROUP BY contract_id)
  SELECT contract_id, t.total::BIGINT AS total, CAST(coalesce(floor(covered + 0.5), 0) AS BIGINT) AS covered, CAST(t.total - coalesce(floor(covered + 0.5), 0) AS BIGINT) AS patient, CAST(floor(coalesce(covered, 0) / t.total * 100 + 0.5) AS BIGINT) AS pct FROM (SELECT DISTINCT contract_id FROM asg) LEFT JOIN c USING (contract_id), (SELECT sum(total) AS total FROM described) t""")
def a42(spark, sf):
    return C.simulate_coverage(star.described(spark, sf), assignments(spark, sf), SIM_MAP)
