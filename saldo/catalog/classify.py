"""Predicates and classifiers over items, lines, findings and contract cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ACCOUNTS, DESCRIBED, LINES, PARTS, RULES, any_like, rx, strict, upper
from saldo.catalog.registry import query
from saldo.catalog.scalars import CELLS, _cells
from saldo.functions import lexicon as lx
from saldo.operators import classify as K
from saldo.sources import star

D, S = strict("description"), strict("section")
DD = f"{DESCRIBED}, d AS (SELECT *, {D} AS nd, {S} AS ns FROM described)"


def chain(c: str, rules, default: str) -> str:
    """CASE over (name, pattern) pairs."""
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE {default} END"


def words(c: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_like(c, w)} THEN '{n}'" for n, w in rules) + f" ELSE {default} END"


CLASS_SQL = {
    "amenity": any_like("nd", lx.AMENITY), "clinical_act": f"({any_like('nd', lx.CLINICAL_ACT)} AND NOT {any_like('nd', lx.NON_CLINICAL)})",
    "admin": any_like("nd", lx.ADMIN), "eligible_strong": any_like("nd", lx.ELIGIBLE_STRONG),
    "eligible_weak": f"regexp_matches(nd, '{lx.ELIGIBLE_WEAK_PATTERN}')", "belongs": any_like("ns", lx.BELONGING_SECTION),
    "surgical_drug": any_like("nd", lx.SURGICAL_DRUG)}


@query("p01_item_classes", f"WITH {DD} SELECT account, " + ", ".join(f"count(*) FILTER (WHERE {s}) AS {n}" for n, s in CLASS_SQL.items()) + " FROM d GROUP BY account")
def p01(spark, sf):
    d = star.described(spark, sf)
    return d.groupBy("account").agg(*[F.count_if(c).alias(n) for n, c in K.item_classes(F.col("description"), F.col("section")).items()])


@query("p02_material_buckets", f"WITH {DD} SELECT {chain('description', [(n, '(?i)' + p) for n, p in lx.MATERIAL_BUCKETS], repr(lx.MATERIAL_OTHER))} AS bucket, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM d GROUP BY 1")
def p02(spark, sf):
    d = star.described(spark, sf).select(K.material_bucket(F.col("description")).alias("bucket"), "total")
    return d.groupBy("bucket").agg(F.count("*").alias("items"), F.sum("total").alias("amount"))


GROUP_SQL = words(upper("description"), lx.SETTLEMENT_GROUPS, "'OTROS'")


@query("p03_settlement_groups", f"WITH {LINES} SELECT line_id, {GROUP_SQL} AS grp FROM lines")
def p03(spark, sf):
    return star.settlement_lines(spark, sf).select("line_id", K.settlement_group(F.col("description")).alias("grp"))


DOMAIN_SQL = f"""CASE WHEN code = '3101002' THEN 'MATERIALES_CLINICOS' WHEN code = '3101001' THEN 'MEDICAMENTOS_HOSP' WHEN code = '3000000' THEN 'HOSPITALIZACION'
  WHEN code IN ('3201001', '3201002') THEN 'OTROS' WHEN code LIKE '01%' THEN 'CONSULTA' WHEN substr(code, 1, 2) IN ('02', '03', '04', '07', '08', '09') THEN 'EXAMENES'
  WHEN substr(code, 1, 2) IN ('05', '06') THEN 'KINESIOLOGIA'
  WHEN substr(code, 1, 2) IN ('11', '12') THEN CASE WHEN regexp_matches({D}, 'quirofano|pabellon|recuperac|anestesia') THEN 'PABELLON' ELSE 'HOSPITALIZACION' END
  WHEN substr(code, 1, 2) BETWEEN '13' AND '20' THEN 'HONORARIOS' WHEN code LIKE '21%' THEN 'MEDICAMENTOS_HOSP' WHEN code LIKE '31%' THEN 'MATERIALES_CLINICOS'
  WHEN code LIKE '32%' THEN 'OTROS' ELSE {words(D, lx.KEYWORD_DOMAIN, "'OTROS'")} END"""


@query("p04_contract_domain", f"WITH {PARTS} SELECT part, {DOMAIN_SQL} AS domain FROM parts")
def p04(spark, sf):
    return star.parts(spark, sf).select("part", K.contract_domain(F.col("code"), F.col("description")).alias("domain"))


DRUG_SQL = f"""(NOT {any_like('nd', lx.DRUG_EXCLUDED)} AND ({any_like('ns', lx.DRUG_SECTION)} OR (contains(ns, 'pabellon') AND (contains(nd, 'mg') OR contains(nd, 'ml') OR contains(nd, 'inyect')))
  OR {any_like('nd', lx.DRUG_FORM)} OR {any_like('nd', lx.DRUG_NAME)} OR regexp_matches(nd, '{lx.DOSAGE_PATTERN}')))"""
SUPPLY_SQL = f"""(NOT {any_like('nd', lx.SUPPLY_EXCLUDED)} AND NOT {any_like('nd', lx.SUPPLY_COMFORT)} AND ((contains(nd, 'manga') AND contains(nd, 'laparosc'))
  OR {any_like('ns', lx.SUPPLY_SECTION)} OR {any_like('nd', lx.SUPPLY_NAME)}))"""


@query("p05_domain_filters", f"WITH {DD} SELECT account, count(*) FILTER (WHERE {DRUG_SQL}) AS drugs, count(*) FILTER (WHERE {SUPPLY_SQL}) AS supplies FROM d GROUP BY account")
def p05(spark, sf):
    d, s = F.col("description"), F.col("section")
    return star.described(spark, sf).groupBy("account").agg(F.count_if(K.is_drug(s, d)).alias("drugs"), F.count_if(K.is_supply(s, d)).alias("supplies"))


GLOSS_SQL = f"""CASE WHEN valor > 0 AND copago::DOUBLE / valor > 0.95 AND (contains({D}, 'no cubierto') OR contains({D}, 'gastos') OR code LIKE '320%') THEN 'TGE_A'
  WHEN contains({D}, 'no contemplad') OR contains({D}, 'no arancel') THEN 'TGE_B' ELSE 'NONE' END"""


@query("p06_gloss_type", f"WITH {LINES} SELECT line_id, {GLOSS_SQL} AS gloss FROM lines")
def p06(spark, sf):
    c = F.col
    return star.settlement_lines(spark, sf).select("line_id", K.gloss_type(c("code"), c("description"), c("valor"), c("copago")).alias("gloss"))


# Declared amounts that do not add up: the part of the item shares that rounding or tax leaves out.
GATE_LINES = f"""{LINES}, gl AS (SELECT *, CASE WHEN provider % 7 = 0 THEN bonif - bonif // 20 ELSE bonif END AS said, CASE WHEN provider % 11 = 0 THEN -copago ELSE copago END AS cp FROM lines)"""


@query("p07_line_warnings", f"""WITH {GATE_LINES}, {ACCOUNTS}, w AS (
  SELECT account, line_id, CASE WHEN cp < 0 THEN ['COPAGO_INVALID'] ELSE [] END || CASE WHEN valor > 0 AND said >= 0 AND cp >= 0 AND abs(said + cp - valor) > valor * 0.02 + 50 THEN ['INCOHERENT'] ELSE [] END AS warnings, cp FROM gl),
  t AS (SELECT account, CAST(sum(cp) AS BIGINT) AS copago, count(*) FILTER (WHERE len(warnings) > 0) AS warned FROM w GROUP BY account)
  SELECT account, copago, warned, abs(copago - stated_total) > 500 AS mismatch, warned = 0 AND abs(copago - stated_total) <= 500 AS strict_ok FROM t JOIN accounts USING (account)""")
def p07(spark, sf):
    from saldo.operators import reports
    c = F.col
    lines = star.settlement_lines(spark, sf).withColumn("bonif", F.when(c("provider") % 7 == 0, F.expr("bonif - bonif div 20")).otherwise(c("bonif"))).withColumn(
        "copago", F.when(c("provider") % 11 == 0, -c("copago")).otherwise(c("copago")))
    declared = star.accounts(spark, sf).select("account", F.col("stated_total").alias("declared"))
    return reports.input_gates(lines, declared)


@query("p08_zero_line_skip", f"WITH {LINES} SELECT account, count(*) AS kept FROM lines WHERE NOT (valor = 0 AND bonif = 0 AND copago = 0) GROUP BY account")
def p08(spark, sf):
    lines = star.settlement_lines(spark, sf)
    return lines.filter(~K.is_zero_line(F.col("valor"), F.col("bonif"), F.col("copago"))).groupBy("account").agg(F.count("*").alias("kept"))


@query("p09_cleaned_settlement", f"WITH {LINES} SELECT line_id, code, bonif, copago FROM lines WHERE bonif > 0 OR copago > 0")
def p09(spark, sf):
    return star.settlement_lines(spark, sf).filter("bonif > 0 or copago > 0").select("line_id", "code", "bonif", "copago")


@query("p10_billing_model", f"""WITH {DESCRIBED}, q AS (SELECT *, CASE WHEN page = 1 THEN qty / 100 ELSE qty END AS q, unit_price AS u FROM described),
  c AS (SELECT *, CASE WHEN q > 0 AND u > 0 AND total > 0 AND abs(total / q - u) / greatest(total / q, u) > 0.30 THEN 'shift'
    WHEN abs(total - q * u) <= greatest(2.0, total * 0.002) AND u < 2000000 THEN 'exact'
    WHEN q < 2 AND ((q < 0.99 AND q > 0) OR len(list_filter([{', '.join(str(v) for v in lx.PRORATION)}]::DOUBLE[], lambda v: abs(q - v) < 0.015)) > 0) THEN 'prorated' ELSE 'review' END AS k FROM q)
  SELECT account, CASE k WHEN 'shift' THEN 'UNIT_PRICE_UNTRUSTED' WHEN 'prorated' THEN 'PRORATED_REFERENCE_PRICE' ELSE 'MULTIPLICATIVE_EXACT' END AS model,
    count(*) AS n, CAST(sum(total) AS BIGINT) AS amount, min(CASE k WHEN 'shift' THEN 0.0 WHEN 'exact' THEN 1.0 WHEN 'prorated' THEN 0.5 ELSE 0.8 END::DOUBLE) AS low_trust FROM c GROUP BY ALL""")
def p10(spark, sf):
    d = star.described(spark, sf)
    q = F.when(F.col("page") == 1, F.col("qty") / 100).otherwise(F.col("qty"))
    m = d.select("account", K.billing_model(q, F.col("unit_price"), F.col("total")).alias("m"))
    return m.groupBy("account", F.col("m.model").alias("model")).agg(
        F.count("*").alias("n"), F.sum("m.authoritative_total").alias("amount"), F.min("m.trust").alias("low_trust"))


ZONE_SQL = chain("upper(section)", lx.ZONES, "'OTROS'")
FAMILY_SQL = chain("upper(description)", lx.FAMILIES, "'INSUMOS_MATERIALES'")
TAX = f"""{DESCRIBED}, f AS (SELECT *, {ZONE_SQL} AS zone, {FAMILY_SQL} AS family FROM described),
  tax AS (SELECT *, CASE WHEN family = 'MEDICAMENTOS' AND zone = 'PABELLON' THEN 'C3.1 - MEDICAMENTOS PABELLON' WHEN family = 'MEDICAMENTOS' THEN 'C3.2 - MEDICAMENTOS HOSPITALIZACION'
    WHEN family = 'INSUMOS_MATERIALES' THEN {chain("upper(description)", lx.SUPPLY_SUBFAMILIES, "'OTROS'")} ELSE 'OTROS' END AS subfamily FROM f)"""


def taxed(spark, sf):
    d = star.described(spark, sf)
    return d.withColumn("t", K.taxonomy(F.col("section"), F.col("description"))).select("*", "t.*").drop("t")


@query("p11_taxonomy", f"WITH {TAX} SELECT zone, family, subfamily, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM tax GROUP BY ALL")
def p11(spark, sf):
    return taxed(spark, sf).groupBy("zone", "family", "subfamily").agg(F.count("*").alias("items"), F.sum("total").alias("amount"))


@query("p12_taxonomy_integrity", f"""WITH {TAX} SELECT account, count(*) FILTER (WHERE (family = 'MEDICAMENTOS' AND regexp_matches(upper(description), '{lx.SUPPLY_WORDS}'))
  OR (family = 'INSUMOS_MATERIALES' AND regexp_matches(upper(description), '{lx.DRUG_WORDS}'))) AS inconsistent FROM tax GROUP BY account""")
def p12(spark, sf):
    ok = K.taxonomy_consistent(F.col("family"), F.col("description"))
    return taxed(spark, sf).groupBy("account").agg(F.count_if(~ok).alias("inconsistent"))


ANCHORS = """anchors AS (SELECT account, bool_or(regexp_matches(section, '(?i)pabell')) AS has_surgery, bool_or(regexp_matches(section, '(?i)d[ií]as?\\s*cama|hospitaliz')) AS has_bed,
  bool_or(regexp_matches(section, '(?i)urgenc')) AS has_urgency FROM described GROUP BY account)"""
E_ = lx.ETIOLOGY
ETI = f"""{TAX}, {ANCHORS}, n AS (SELECT *, CASE WHEN {rx('description', E_['anesthesia'])} THEN 'ANESTESIA' WHEN {rx('description', E_['surgical'])} THEN 'MATERIAL_QUIRURGICO'
   WHEN {rx('description', E_['bed_hotel'])} THEN 'HOTELERIA' WHEN {rx('description', E_['ward_supply'])} THEN 'INSUMO_SALA' WHEN {rx('description', E_['drug'])} THEN 'MEDICAMENTO_GENERAL' END AS nature
   FROM tax JOIN anchors USING (account)),
  b AS (SELECT *, CASE WHEN has_surgery AND nature IN ('ANESTESIA', 'MATERIAL_QUIRURGICO') THEN 'PABELLON' WHEN has_bed AND nature IN ('HOTELERIA', 'INSUMO_SALA') THEN 'DIA_CAMA' END AS absorbed FROM n),
  eti AS (SELECT *, CASE WHEN {rx('description', E_['accessory'])} THEN 'M1_FRAUDE_TECNICO' WHEN {rx('description', E_['hotel'])} THEN 'M3_ABSORCION_NORMATIVA'
    WHEN {rx('description', E_['standard_supply'])} AND (has_surgery OR has_bed) THEN 'M2_UNBUNDLING_CLINICO' WHEN regexp_matches(description, '{E_['schedule_code']}') THEN 'CORRECTO'
    WHEN absorbed = 'PABELLON' AND NOT regexp_matches(section, '(?i)pabell') THEN 'M2_UNBUNDLING_CLINICO' WHEN absorbed IS NOT NULL THEN 'CORRECTO' END AS etype FROM b)"""


def explained(spark, sf):
    """Items with account anchors and etiology."""
    from saldo.operators import signals
    t = taxed(spark, sf)
    a = signals.account_anchors(t)
    j = t.join(a, "account")
    return j.withColumn("etiology", K.etiology(F.col("description"), F.col("section"), F.col("has_surgery"), F.col("has_bed")))


@query("p13_etiology", f"WITH {ETI} SELECT account, coalesce(etype, 'AMBIGUA') AS etype, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM eti GROUP BY ALL")
def p13(spark, sf):
    return explained(spark, sf).groupBy("account", F.coalesce("etiology.type", F.lit("AMBIGUA")).alias("etype")).agg(
        F.count("*").alias("items"), F.sum("total").alias("amount"))


@query("p14_item_rules", f"""WITH {ETI}, r AS (SELECT *, {D} AS nd FROM eti), u AS (
  SELECT account, total, 'R-HOT-01' AS rule_id, 'HIGH' AS severity FROM r WHERE has_bed AND {any_like('nd', lx.AMENITY)} AND family <> 'ESTADA_CAMA'
  UNION ALL SELECT account, total, 'R-PAB-01', 'HIGH' FROM r WHERE has_surgery AND {any_like('nd', lx.ELIGIBLE_STRONG)} AND zone <> 'PABELLON'
  UNION ALL SELECT account, total, 'R-ADM-01', 'WARN' FROM r WHERE {any_like('nd', lx.ADMIN)})
  SELECT account, rule_id, severity, count(*) AS fired, CAST(sum(total) AS BIGINT) AS amount FROM u GROUP BY ALL""")
def p14(spark, sf):
    c = F.col
    fired = explained(spark, sf).select("account", "total", F.explode(K.item_rules(c("family"), c("zone"), c("description"), c("has_bed"), c("has_surgery"))).alias("r"))
    return fired.groupBy("account", c("r.rule_id").alias("rule_id"), c("r.severity").alias("severity")).agg(F.count("*").alias("fired"), F.sum("total").alias("amount"))


COST_SQL = f"CASE {' '.join(f'''WHEN regexp_matches(upper(description), '{p}') THEN '{n}' ''' for n, p in lx.COST_CLASSES)} WHEN regexp_matches(section, '(?i){lx.COST_CLASS_SECTION}') THEN 'III' END"


@query("p15_cost_class", f"WITH {DESCRIBED} SELECT coalesce({COST_SQL}, 'NONE') AS cost_class, count(*) AS items, CAST(sum(copago) AS BIGINT) AS copago FROM described GROUP BY 1")
def p15(spark, sf):
    d = star.described(spark, sf)
    return d.groupBy(F.coalesce(K.cost_class(F.col("description"), F.col("section")), F.lit("NONE")).alias("cost_class")).agg(
        F.count("*").alias("items"), F.sum("copago").alias("copago"))


# Findings derived from item rules: the item text as label, a rationale by section.
FIND = f"""{DESCRIBED}, finds AS (SELECT account, part, total, copago AS amount, description AS label, folio,
  CASE section WHEN 'PABELLON' THEN 'UNBUNDLING de pabellon' WHEN 'FARMACIA' THEN 'Opacidad: sin desglose' WHEN '' THEN 'Incumplimiento con precedente' WHEN 'URGENCIA' THEN 'Excede tope UF' ELSE 'Varios sin detalle' END AS rationale,
  CASE substr(folio, 1, 1) WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'Z' END AS category FROM described)"""


def findings(spark, sf):
    c = F.col
    d = star.described(spark, sf)
    why = K.lookup(c("section"), {"PABELLON": "UNBUNDLING de pabellon", "FARMACIA": "Opacidad: sin desglose", "": "Incumplimiento con precedente",
                                  "URGENCIA": "Excede tope UF"}, "Varios sin detalle")
    cat = K.lookup(F.substring("folio", 1, 1), {"A": "A", "R": "B"}, "Z")
    return d.select("account", "part", "total", c("copago").alias("amount"), c("description").alias("label"), "folio", "ts", "provider", "page",
                    why.alias("rationale"), cat.alias("category"))


G_, T_ = "upper(label)", "upper(rationale)"
P16_SQL = f"""CASE WHEN regexp_matches({T_}, 'UNBUNDLING|EVENTO|FRAGMENTA|DUPLICI|DOBLE COBRO') OR regexp_matches({G_}, 'UNBUNDLING|EVENTO') THEN 'A'
  WHEN (regexp_matches({G_}, 'ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION') OR contains({T_}, 'IF-319')) AND regexp_matches({T_}, 'DUPLICI|DOBLE|INCLU') THEN 'A'
  WHEN regexp_matches({G_}, 'MEDICAMENTO|INSUMO|MATERIAL|FARMACO') AND (regexp_matches({T_}, 'SIN BONIFI|COBERTURA 0|BONIFICACION \\$0|NO CUBIERTO') OR contains({G_}, 'SIN BONIFI')) THEN 'B'
  WHEN regexp_matches({T_}, 'SIGNOS VITALES|CURACION|INSTALACION VIA|FLEBOCLISIS|ENFERMERIA|TOMA DE MUESTRA') OR contains({G_}, 'ENFERMERIA') THEN 'A'
  WHEN regexp_matches({T_}, 'PROPOFOL|FENTANILO|SEVOFLURANO|MIDAZOLAM|ANESTESIA|ROCURONIO|VECURONIO') AND regexp_matches({T_}, 'PABELLON|QUIROFANO') THEN 'A'
  WHEN regexp_matches({G_}, 'VARIOS|AJUSTE|DIFERENCIA|ESTADO DE CUENTA OPACO') OR regexp_matches({T_}, 'VARIOS|AJUSTE|BORROSO|SIN DESGLOSE') THEN 'A'
  WHEN regexp_matches({T_}, 'UPCODING|INFLA|PRECIO EXCESIVO|DOSIS COMPLETA') THEN 'A'
  WHEN regexp_matches({T_}, 'EVENTO UNICO|URGENCIA.*INTEGRADO|URGENCIA.*HOSPITALIZACION') THEN 'A' ELSE 'B' END"""


@query("p16_finding_category", f"WITH {FIND} SELECT account, {P16_SQL} AS cat, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM finds GROUP BY ALL")
def p16(spark, sf):
    return findings(spark, sf).groupBy("account", K.finding_category(F.col("label"), F.col("rationale")).alias("cat")).agg(
        F.count("*").alias("n"), F.sum("amount").alias("amount"))


NORM_SQL = f"""(regexp_matches({G_}, 'UNBUNDLING|EVENTO UNICO|FRAGMENTA|DUPLICI|DOBLE COBRO|ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION|ASEO PERSONAL|SET DE ASEO|SIGNOS VITALES|CURACION|INSTALACION VIA|FLEBOCLISIS|ENFERMERIA|TOMA DE MUESTRA|URGENCIA.*HOSPITALIZACION|BONIFICACION INCORRECTA|INCUMPLIMIENTO CONTRACTUAL|DIFERENCIA COBERTURA|RECLASIFICACION ESTRATEGICA')
  OR regexp_matches({T_}, 'UNBUNDLING|EVENTO|IF-?319|ENFERMERIA|ALERTA_EU_01') OR regexp_matches({T_}, '(COBERTURA|BONIFICACION).*(100%|TOTAL|COMPLETA)'))"""
UNCOV_SQL = f"(regexp_matches({G_}, 'GASTOS? NO CUBIERTO|PRESTACION NO CONTEMPLADA|VARIOS|AJUSTES|3201001|3201002') AND amount > 0)"
FLAGS = f"{FIND}, ev AS (SELECT account, bool_or(section = 'PABELLON') AS surgical, bool_or(section IN ('PABELLON', 'HOSPITALIZACION')) AS stay FROM described GROUP BY account), ff AS (SELECT * FROM finds JOIN ev USING (account))"
PROT_SQL = f"""(({UNCOV_SQL} AND (surgical OR (stay AND regexp_matches({T_}, 'ASEO|CONFORT|KITS?|ROPA|PIJAMA|TERMOMETRO|MUESTRA')) OR regexp_matches({T_}, 'EPP|SEGURIDAD|INFRAESTRUCTURA|COSTO OPERACIONAL|INSUMO INSTITUCIONAL')
  OR regexp_matches({T_}, '(COBERTURA|BONIFICACION).*(100%|TOTAL|COMPLETA)'))) OR {NORM_SQL})"""


def flagged(spark, sf):
    d = star.described(spark, sf)
    ev = d.groupBy("account").agg(F.bool_or(F.col("section") == "PABELLON").alias("surgical"),
                                  F.bool_or(F.col("section").isin("PABELLON", "HOSPITALIZACION")).alias("stay"))
    c = F.col
    f = findings(spark, sf).join(ev, "account")
    none = F.lit(None).cast("string")
    return f.withColumns({"protected": K.is_protected(c("label"), c("rationale"), c("amount"), none, c("surgical"), c("stay")),
                          "opaque": K.is_opaque(c("label"), c("rationale"), c("category"), F.lit(False))})


@query("p17_protected_findings", f"WITH {FLAGS} SELECT account, count(*) FILTER (WHERE {PROT_SQL}) AS protected, CAST(coalesce(sum(amount) FILTER (WHERE {PROT_SQL}), 0) AS BIGINT) AS amount FROM ff GROUP BY account")
def p17(spark, sf):
    p = F.col("protected")
    return flagged(spark, sf).groupBy("account").agg(F.count_if(p).alias("protected"), F.coalesce(F.sum(F.when(p, F.col("amount"))), F.lit(0)).alias("amount"))


OPAQUE_SQL = f"""(NOT (regexp_matches({T_}, 'NO MAPEA|FALTA DICCIONARIO|FALTA TABLA|NEEDS_MAPPING') OR regexp_matches({T_}, '(COBERTURA|BONIFICACION).*(100%|TOTAL|COMPLETA)') OR regexp_matches({G_}, 'INCUMPLIMIENTO CONTRACTUAL|UNBUNDLING|EVENTO UNICO|RECLASIFICACION'))
  AND (category = 'Z' OR regexp_matches({G_}, 'OPACIDAD|INDETERMINADO|BORROSO|SIN DESGLOSE|CARGA DE LA PRUEBA|LEY 20.?584|PRESTACION NO CONTEMPLADA|GASTOS? NO CUBIERTO|VARIOS|AJUSTE|DIFERENCIA') OR regexp_matches({T_}, 'OPACIDAD|INDETERMINADO|BORROSO|SIN DESGLOSE|RECOLECCION')))"""


@query("p18_opaque_findings", f"WITH {FLAGS} SELECT account, count(*) FILTER (WHERE {OPAQUE_SQL}) AS opaque FROM ff GROUP BY account")
def p18(spark, sf):
    return flagged(spark, sf).groupBy("account").agg(F.count_if("opaque").alias("opaque"))




@query("p19_categorize", f"""WITH {FIND}, ev AS (SELECT account, bool_or(section = 'PABELLON') AS surgical, bool_or(section IN ('PABELLON', 'HOSPITALIZACION')) AS stay FROM described GROUP BY account),
  fp AS (SELECT account, copago AS amount, description AS label, CASE section WHEN 'PABELLON' THEN 'UNBUNDLING de pabellon' WHEN 'FARMACIA' THEN 'Opacidad: sin desglose' WHEN '' THEN 'Incumplimiento con precedente' WHEN 'URGENCIA' THEN 'Excede tope UF' ELSE 'Varios sin detalle' END AS rationale,
    CASE substr(folio, 1, 1) WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'Z' END AS category, page FROM described),
  r AS (SELECT account, label, count(*) AS repeats, count(DISTINCT page) > 1 AS several FROM fp GROUP BY ALL),
  x AS (SELECT *, {PROT_SQL} AS protected, {OPAQUE_SQL} AS opaque FROM fp JOIN ev USING (account) JOIN r USING (account, label)),
  y AS (SELECT account, amount, CASE WHEN regexp_matches({G_} || {T_}, 'TOPE|TECHO|UF|VAM|AC2|PRORRATEO|VALORIZACION') AND NOT regexp_matches({G_} || {T_}, 'UNBUNDLING|FRAGMENTACION|FRAGMENTADO|INCOMPATIBILIDAD') THEN 'Z'
    WHEN amount > 0 AND (category = 'A' OR protected) THEN 'A'
    WHEN amount > 0 AND category = 'B' AND repeats >= 2 AND regexp_matches({T_}, CASE WHEN several THEN 'INCUMPLIMIENTO|DERECHO|DOCTRINA|PRECEDENTE|JURISPRUDENCIA' ELSE 'PRECEDENTE|JURISPRUDENCIA' END) THEN 'A'
    WHEN opaque OR ((regexp_matches({G_}, 'MEDICAMENTO|MATERIAL|INSUMO|FARMACO') OR regexp_matches({T_}, 'MEDICAMENTO|MATERIAL|INSUMO|FARMACO')) AND NOT protected) THEN 'Z'
    WHEN amount <= 0 THEN 'OK' ELSE category END AS cat FROM x)
  SELECT account, cat, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM y GROUP BY ALL""")
def p19(spark, sf):
    from saldo.operators import findings as fo
    f = fo.pattern_counts(flagged(spark, sf), event="page")
    f = f.withColumns({"resolved": F.lit(False), "unit_ok": F.lit(False), "validated": F.lit(False)})
    c = fo.categorized(f)
    return c.groupBy("account", F.col("category").alias("cat")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("p20_promotion_gate", f"""WITH {FIND}, r AS (SELECT account, description AS label, count(*) AS repeats, count(DISTINCT page) > 1 AS several, bool_or(section = '') AS backed FROM described GROUP BY ALL)
  SELECT account, label, repeats, several, repeats >= 2 AND backed AS promoted FROM r""")
def p20(spark, sf):
    d = star.described(spark, sf)
    r = d.groupBy("account", F.col("description").alias("label")).agg(
        F.count("*").alias("repeats"), (F.min("page") != F.max("page")).alias("several"), F.bool_or(F.col("section") == "").alias("backed"))
    return r.select("account", "label", "repeats", "several", K.can_promote(F.col("repeats"), F.col("several"), F.col("backed"), F.col("backed")).alias("promoted"))


@query("p21_unit_dependency", f"""WITH {FIND} SELECT account, count(*) FILTER (WHERE regexp_matches({G_} || {T_}, 'TOPE|TECHO|UF|VAM|AC2|PRORRATEO|VALORIZACION') AND NOT regexp_matches({G_} || {T_}, 'UNBUNDLING|FRAGMENTACION|FRAGMENTADO|INCOMPATIBILIDAD')) AS needs_unit,
  count(*) FILTER (WHERE total % 100 / 100.0 >= CASE WHEN category = 'B' THEN 0.8 ELSE 0.7 END) AS verifiable FROM finds GROUP BY account""")
def p21(spark, sf):
    c = F.col
    kind = F.when(c("category") == "B", "INFERENCIA_POR_PATRON").otherwise("TOPE_EXPLICITO")
    ok = K.unit_verifiable(F.lit("VERIFICABLE"), (c("total") % 100) / 100, kind)
    return findings(spark, sf).groupBy("account").agg(F.count_if(K.needs_unit(c("label"), c("rationale"))).alias("needs_unit"), F.count_if(ok).alias("verifiable"))


@query("p26_opacity_score", f"""WITH {LINES}, s AS (SELECT *, {D} AS nd, CASE WHEN items = 1 THEN 'TRACE_OK' WHEN items <= 2 THEN 'TRACE_WEAK' ELSE 'TRACE_NONE' END AS level FROM lines),
  p AS (SELECT line_id, CASE WHEN copago = 0 AND bonif > 0 THEN 0 ELSE CASE WHEN (code IN ('3101002', '3201001', '3101001', '3201002', '3000000') OR contains(nd, 'no cubierto')) AND level <> 'TRACE_OK' THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(nd, 'no cubierto|insumos|gasto') THEN 20 ELSE 0 END + CASE WHEN bonif = 0 AND copago > 0 THEN 15 ELSE 0 END + CASE WHEN level = 'TRACE_NONE' THEN 15 ELSE 0 END END AS score FROM s)
  SELECT line_id, score, score >= 40 AS applies FROM p""")
def p26(spark, sf):
    c = F.col
    lines = star.settlement_lines(spark, sf)
    level = F.when(c("items") == 1, "TRACE_OK").when(c("items") <= 2, "TRACE_WEAK").otherwise("TRACE_NONE")
    return lines.select("line_id", K.opacity_score(c("code"), c("description"), c("bonif"), c("copago"), level).alias("o")).select("line_id", "o.score", "o.applies")


@query("p32_finding_state", f"""WITH {FIND}, s AS (SELECT account, bool_or(category = 'A') AS a, bool_or(category = 'Z') AS z, bool_or(category = 'B') AS b FROM finds GROUP BY account)
  SELECT account, CASE WHEN a THEN 'IMPROCEDENTE' WHEN z THEN 'INDETERMINADO' WHEN b THEN 'EN_CONTROVERSIA' ELSE 'VALIDABLE' END AS state,
  CASE WHEN a THEN 'IMPUGNAR / EXTORNO' WHEN z THEN 'SOLICITAR ACLARACION' WHEN b THEN 'SOLICITAR DESGLOSE / RELIQUIDACION' ELSE 'OK' END AS action FROM s""")
def p32(spark, sf):
    has = lambda k: F.bool_or(F.col("category") == k)
    g = findings(spark, sf).groupBy("account").agg(has("A").alias("a"), has("Z").alias("z"), has("B").alias("b"))
    return g.select("account", K.finding_state(F.col("a"), F.col("z"), F.col("b")).alias("s")).select("account", "s.*")


@query("p33_evidence_needed", f"""WITH {FIND} SELECT label, rationale, CASE WHEN regexp_matches(upper(label || ' ' || rationale), 'OPACIDAD|SIN DESGLOSE|CAJA NEGRA') THEN 'RELIQUIDACION_CON_DESGLOSE'
  WHEN regexp_matches(upper(label || ' ' || rationale), 'HOTELERIA|ALIMENTACION|UNBUNDLING') THEN 'ACLARACION_DESTINATARIO' ELSE 'ANTECEDENTES_DE_RESPALDO' END AS evidence, count(*) AS n FROM finds GROUP BY ALL""")
def p33(spark, sf):
    f = findings(spark, sf)
    return f.groupBy("label", "rationale", K.evidence_needed(F.concat_ws(" ", "label", "rationale")).alias("evidence")).agg(F.count("*").alias("n"))


CANON_SQL = words("strip_accents(lower(description || ' ' || section))", K.CANONICAL_CATEGORIES, "'OTRO'")


@query("p34_canonical_category", f"WITH {PARTS} SELECT part, {CANON_SQL} AS category FROM parts")
def p34(spark, sf):
    return star.parts(spark, sf).select("part", K.canonical_category(F.concat_ws(" ", "description", "section")).alias("category"))


@query("p35_section_of_benefit", f"""WITH {PARTS} SELECT part, CASE WHEN section IN ('PABELLON') THEN 'HOSPITALARIAS_Y_CIRUGIA_MAYOR_AMBULATORIA' WHEN section = 'URGENCIA' THEN 'ATENCIONES_DE_URGENCIA' ELSE 'OTRAS_PRESTACIONES' END AS benefit_section,
  CASE WHEN contains(description, 'HONORARIO') THEN 'HONORARIOS' END AS domain FROM parts WHERE section <> 'URGENCIA' UNION ALL
  SELECT part, 'ATENCIONES_DE_URGENCIA', 'URGENCIA' FROM parts WHERE section = 'URGENCIA'""")
def p35(spark, sf):
    return star.parts(spark, sf).select("part", K.benefit_section(F.col("section")).alias("benefit_section"),
                                        K.section_domain(F.concat_ws(" ", "section", "description")).alias("domain"))


@query("p36_page_type", """WITH t AS (SELECT page_id, strip_accents(lower(html)) AS t FROM pages), k AS (SELECT page_id, t, len(regexp_extract_all(t, '%')) AS pc, len(regexp_extract_all(t, '\\b\\d{7}\\b')) AS cd,
  len(regexp_extract_all(t, 'tipo de plan|tabla de factores|cotizacion legal|cotizantes|cargas|tramos de edad|precio base')) AS me, len(regexp_extract_all(t, 'hospital|dia cama|pabell|honorar|medicament|material|insumo|urgenc')) AS co FROM t)
  SELECT page_id, CASE WHEN regexp_matches(t, 'tiempo maximo|garantia explicita') THEN 'WAIT_TIMES_TABLE' WHEN (me >= 5 AND pc <= 2) OR (me >= 2 AND co = 0 AND pc = 0) THEN 'FACTOR_TABLE' WHEN cd > 5 AND pc = 0 THEN 'ARANCEL_CATALOG'
  WHEN regexp_matches(t, 'definicion|glosario|condiciones generales|articulo|circular|en virtud de') AND pc < 2 AND co = 0 THEN 'DEFINITIONS_TEXT'
  WHEN (co >= 1 AND (pc >= 1 OR regexp_matches(t, '\\buf\\b|\\bv\\.?a\\.?\\b|\\bvam\\b|sin\\s+tope|copago'))) OR (regexp_matches(t, 'preferente|libre\\s*elecci|bonificaci|tope|copago') AND pc >= 1) THEN 'COVERAGE_GRID' ELSE 'UNKNOWN' END AS kind FROM k""")
def p36(spark, sf):
    from saldo.functions.text import fold
    return star.table(spark, sf, "pages").select("page_id", K.page_type(fold(F.lower("html"))).alias("kind"))


EFFECT_SQL = "CASE WHEN contains(lower(cell), 'sin tope') THEN 'EXPANSIVO' WHEN regexp_matches(lower(cell), 'tope|uf|ac2|veces|\\b\\d+([.,]\\d+)?\\s*x\\b') THEN 'LIMITANTE' ELSE 'NEUTRO' END"
SCOPE_SQL = "CASE WHEN size % 8 IN (2, 4, 5, 6) THEN 'TOPE_EVENTO' WHEN size % 8 = 7 THEN 'TOPE_ANUAL_NFE' WHEN contains(cell, '%') THEN 'PORCENTAJE' ELSE 'FINANCIAL_DOMAIN' END"


@query("p37_line_effect", f"WITH {CELLS} SELECT part, {EFFECT_SQL} AS effect, {SCOPE_SQL} AS scope FROM cells")
def p37(spark, sf):
    col = (F.col("size") % 8).cast("int")
    return _cells(spark, sf).select("part", K.line_effect(F.col("cell")).alias("effect"), K.line_scope(col, F.col("cell")).alias("scope"))


@query("p38_line_operators", f"""WITH {CELLS}, s AS (SELECT *, {SCOPE_SQL} AS scope FROM cells) SELECT part, list_filter([CASE WHEN scope = 'TOPE_EVENTO' THEN scope END, CASE WHEN scope = 'TOPE_ANUAL_NFE' THEN scope END, CASE WHEN scope = 'PORCENTAJE' THEN scope END], lambda x: x IS NOT NULL) AS ops FROM s""")
def p38(spark, sf):
    col = (F.col("size") % 8).cast("int")
    return _cells(spark, sf).select("part", K.line_operators(col, F.col("cell")).alias("ops"))


@query("p39_modality_lock", f"WITH {CELLS} SELECT part, size % 3 = 0 AS locked FROM cells")
def p39(spark, sf):
    t = F.when(F.col("size") % 3 == 0, F.concat(F.lit("Solo con libre elección "), "cell")).otherwise(F.concat(F.lit("Oferta preferente "), "cell"))
    return _cells(spark, sf).select("part", K.is_modality_lock(t).alias("locked"))


@query("p41_row_policy", f"""WITH {PARTS} SELECT part, CASE WHEN regexp_matches(upper(p_name), 'RING|BOLT') THEN 'ALLOW' WHEN regexp_matches(upper(p_name), 'GEAR|RED') THEN 'REQUIRE' ELSE 'NONE' END AS policy FROM parts""")
def p41(spark, sf):
    from saldo.operators import spatial
    rules = [("RING|BOLT", "ALLOW"), ("GEAR|RED", "REQUIRE")]
    return star.parts(spark, sf).select("part", spatial.row_policy(F.upper("p_name"), rules, "NONE").alias("policy"))


@query("p42_layout_ids", f"""WITH {PARTS}, k AS (SELECT part, CASE size % 4 WHEN 0 THEN 'C' || (size % 7 + 1) || '_LE_PCT' WHEN 1 THEN 'C2_C3' WHEN 2 THEN '' ELSE 'C5_C6_X' END AS c, CASE WHEN size % 2 = 0 THEN 'R_' || upper(split_part(p_name, ' ', 2)) ELSE upper(split_part(p_name, ' ', 2)) END AS r FROM parts)
  SELECT part, CASE WHEN c = '' THEN 'UNKNOWN_COL' WHEN c = 'C2_C3' THEN 'COL_PREF_PCT' WHEN c = 'C5_C6_X' THEN 'COL_LE_PCT' WHEN c IN ('C4_LE_PCT', 'C5_LE_PCT') THEN 'COL_LE_PCT' ELSE c END AS column_id,
  CASE WHEN r LIKE 'R\\_%' ESCAPE '\\' THEN r ELSE 'R_' || r END AS row_id FROM k""")
def p42(spark, sf):
    s, noun = F.col("size"), F.upper(F.split("p_name", " ").getItem(1))
    c = F.when(s % 4 == 0, F.concat(F.lit("C"), (s % 7 + 1).cast("string"), F.lit("_LE_PCT"))).when(s % 4 == 1, "C2_C3").when(s % 4 == 2, "").otherwise("C5_C6_X")
    r = F.when(s % 2 == 0, F.concat(F.lit("R_"), noun)).otherwise(noun)
    return star.parts(spark, sf).select("part", K.column_id(c).alias("column_id"), K.row_id(r).alias("row_id"))


@query("p43_repair_code", f"WITH {PARTS} SELECT part, code AS repaired FROM parts")
def p43(spark, sf):
    missing = F.when(F.col("size") % 2 == 0, F.lit("0")).otherwise(F.col("code"))
    return star.parts(spark, sf).select("part", K.repair_code(missing, F.concat_ws(" ", "code", "description")).alias("repaired"))


NOISE_SQL = "trim(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '\\s+', ' ', 'g'))"


@query("p44_noise_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), n AS (SELECT doc_id, {NOISE_SQL} AS t FROM l)
  SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE contains(t, 'TOTAL') OR NOT regexp_matches(t, '[A-Z]')) AS summary,
    count(*) FILTER (WHERE regexp_matches(t, '^\\d{{7,}}(-[A-Z0-9])?$')) AS code_only, count(*) FILTER (WHERE regexp_matches(t, 'DOCUMENTOS VALORIZADOS|HORA IMPRESION|DOCUMENTO VALIDO POR|NO TIENE COBERTURA|ARANCEL')) AS residue FROM n GROUP BY doc_id""")
def p44(spark, sf):
    lines = star.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    k = lines.select("doc_id", K.noise_kinds(F.col("text")).alias("k"))
    has = lambda n: F.count_if(F.array_contains("k", n))
    return k.groupBy("doc_id").agg(F.count("*").alias("lines"), has("SUMMARY").alias("summary"), has("CODE_ONLY").alias("code_only"), has("RESIDUE").alias("residue"))


SUMS = "s AS (SELECT account, CAST(sum(amount) FILTER (WHERE category = 'A') AS BIGINT) AS a, CAST(sum(amount) FILTER (WHERE category = 'B') AS BIGINT) AS b, CAST(sum(amount) FILTER (WHERE category = 'Z') AS BIGINT) AS z, CAST(sum(amount) AS BIGINT) AS t FROM finds GROUP BY account), z AS (SELECT account, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(z, 0) AS z, t FROM s)"


@query("p46_account_state", f"""WITH {FIND}, {SUMS} SELECT account, CASE WHEN a > 0 AND (z > 0 OR b > 0) THEN 'COPAGO_MIXTO_CONFIRMADO_Y_OPACO' WHEN a > 0 THEN 'COPAGO_OBJETABLE_CONFIRMADO' WHEN z > 0 THEN 'COPAGO_INDETERMINADO_POR_OPACIDAD' WHEN b > 0 THEN 'COPAGO_BAJO_CONTROVERSIA' ELSE 'COPAGO_OK_CONFIRMADO' END AS state,
  CASE WHEN a > 0 THEN 'CUENTA_IMPUGNABLE_POR_INCUMPLIMIENTO_CONTRACTUAL' WHEN z > 0 THEN 'OPACIDAD ESTRUCTURAL (COPAGO INDETERMINADO)' WHEN b > 0 THEN 'CONTROVERSIA POR FALTA DE DESGLOSE' WHEN t - a - b - z = t AND t > 0 THEN 'CORRECTO (VALIDADO)' WHEN t = 0 THEN 'SIN COPAGO INFORMADO' ELSE 'AUDITABLE' END AS decision FROM z""")
def p46(spark, sf):
    s = findings(spark, sf).groupBy("account").agg(*[F.coalesce(F.sum(F.when(F.col("category") == k, F.col("amount"))), F.lit(0)).alias(k.lower()) for k in "ABZ"], F.sum("amount").alias("t"))
    a, b, z, t = (F.col(k) for k in "abzt")
    return s.select("account", K.account_state(a, b, z).alias("state"), K.account_decision(a, b, z, t - a - b - z, t).alias("decision"))


@query("p47_reconstructibility", f"""WITH {RULES}, {ACCOUNTS}, c AS (SELECT contract_id, count(*) > 0 AS has_rules, bool_or(cap_kind = 'SIN_TOPE_EXPRESO' OR pct = 100) AS integral FROM rules GROUP BY contract_id)
  SELECT contract_id, priority, count(*) AS accounts, CASE WHEN has_rules THEN 50 ELSE 0 END + CASE WHEN integral THEN 30 ELSE 0 END AS score, true AS reconstructible FROM c JOIN accounts USING (contract_id) GROUP BY ALL""")
def p47(spark, sf):
    r = star.contract_rules(spark, sf).groupBy("contract_id").agg(
        F.count("*").alias("n"), F.bool_or((F.col("cap_kind") == "SIN_TOPE_EXPRESO") | (F.col("pct") == 100)).alias("integral"))
    a = star.accounts(spark, sf).join(r, "contract_id")
    text = F.when(F.col("integral"), "sin tope").otherwise("")
    s = a.select("contract_id", "priority", K.reconstructibility(F.col("n") > 0, text, F.col("priority")).alias("r"))
    return s.groupBy("contract_id", "priority", "r.score", "r.reconstructible").agg(F.count("*").alias("accounts"))


@query("p51_penalty_score", f"WITH {FIND}, k AS (SELECT account, count(*) FILTER (WHERE category = 'A') AS c, count(*) FILTER (WHERE category = 'B') AS m, count(*) FILTER (WHERE category = 'Z') AS n FROM finds GROUP BY account) SELECT account, least(10.0, greatest(0.0, 10 - c * 3.5::DOUBLE - m * 2.0::DOUBLE - n * 0.8::DOUBLE)) AS score FROM k")
def p51(spark, sf):
    n = lambda k: F.count_if(F.col("category") == k)
    return findings(spark, sf).groupBy("account").agg(K.penalty_score(n("A"), n("B"), n("Z")).alias("score"))


@query("p54_protected_state", f"""WITH {FIND}, {SUMS}, fz AS (SELECT account, bool_or(contains(label, 'PABELLON')) AS frozen FROM finds GROUP BY account), st AS (SELECT account, CASE WHEN a > 0 THEN 'OTHER' WHEN z > 0 THEN 'COPAGO_INDETERMINADO_POR_OPACIDAD' ELSE 'OTHER' END AS s FROM z)
  SELECT account, CASE WHEN s = 'COPAGO_INDETERMINADO_POR_OPACIDAD' AND frozen THEN 'COPAGO_MIXTO_CONFIRMADO_Y_OPACO' ELSE s END AS state FROM st JOIN fz USING (account)""")
def p54(spark, sf):
    c = F.col
    s = findings(spark, sf).groupBy("account").agg(F.sum(F.when(c("category") == "A", c("amount")).otherwise(0)).alias("a"), F.sum(F.when(c("category") == "Z", c("amount")).otherwise(0)).alias("z"),
                                                   F.bool_or(c("label").contains("PABELLON")).alias("frozen"))
    state = F.when(c("a") > 0, "OTHER").when(c("z") > 0, "COPAGO_INDETERMINADO_POR_OPACIDAD").otherwise("OTHER")
    return s.select("account", K.protect_state(state, c("frozen")).alias("state"))
