"""Signals, hypotheses, capability gates, flags and opacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ACCOUNTS, CHARGES, DESCRIBED, ITEMS, LINES, LINES_ONLY, RULES
from saldo.catalog.classify import ANCHORS, COST_SQL, ETI, TAX, explained, taxed
from saldo.catalog.registry import query
from saldo.functions import lexicon as lx
from saldo.operators import classify as K
from saldo.operators import signals as S
from saldo.sources import star


def rx(c, p):
    return f"regexp_matches({c}, '(?i){p}')"


COVER = """cov AS (SELECT account, count(rule_id) FILTER (WHERE account % 4 <> 0) AS n, coalesce(bool_or(domain = 'HOSPITALIZACION') FILTER (WHERE account % 3 = 0), false) AS h, coalesce(bool_or(domain = 'EXAMENES'), false) AS a FROM accounts LEFT JOIN rules USING (contract_id) GROUP BY account)"""


def coverage(spark, sf):
    r = star.contract_rules(spark, sf).groupBy("contract_id").agg(F.count("*").alias("n"), F.bool_or(F.col("domain") == "HOSPITALIZACION").alias("h"), F.bool_or(F.col("domain") == "EXAMENES").alias("a"))
    acc = F.col("account")
    return star.accounts(spark, sf).join(r, "contract_id").select("account", F.when(acc % 4 != 0, F.col("n")).otherwise(0).alias("n_coverages"),
                                                                  ((acc % 3 == 0) & F.col("h")).alias("hospital_cover"), F.col("a").alias("ambulatory_cover"))


def _grp(w):
    h = f"contains(description, '{w}')"
    return f"CASE WHEN bool_or({h} AND {rx('description', S.GROUPED)}) THEN 1.0 WHEN count(*) FILTER (WHERE {h}) BETWEEN 1 AND 2 AND coalesce(sum(copago) FILTER (WHERE {h}), 0) > 10000 THEN 0.9 WHEN bool_or({h}) THEN 0.3 ELSE 0.0 END::DOUBLE"


SIG = f"""{DESCRIBED}, {LINES_ONLY}, {ACCOUNTS}, {RULES}, {COVER}, pm AS (SELECT account, {_grp('MATERIALES')} AS gm, {_grp('MEDICAMENTOS')} AS gd, bool_or({rx('description', S.GENERIC)})::INT::DOUBLE AS gen, CASE WHEN bool_or(regexp_matches(description, 'HONORARIO|CIRUJANO|ANESTESISTA|MEDICO|VISITA|INTERCONSULTA')) THEN 1.0 ELSE 0.0 END::DOUBLE AS vf, CASE WHEN bool_or(contains(description, 'PABELLON')) THEN 1.0 ELSE 0.0 END::DOUBLE AS vs FROM lines GROUP BY account),
  bl AS (SELECT account, bool_or({rx('description', S.DAY_BED)} OR {rx('section', S.DAY_BED)})::INT::DOUBLE AS db, least(1.0, count(*) FILTER (WHERE {rx('description', S.HOTEL)}) / 3.0::DOUBLE) AS ho, least(1.0, count(*) FILTER (WHERE {rx('description', S.FOOD)}) / 2.0::DOUBLE) AS fo FROM described GROUP BY account),
  rp AS (SELECT account, CASE WHEN max(n) > 20 THEN 1.0 WHEN max(n) > 10 THEN 0.7 WHEN max(n) > 5 THEN 0.3 ELSE 0.0 END::DOUBLE AS rep FROM (SELECT account, code, count(*) AS n FROM described GROUP BY ALL) GROUP BY account),
  sg AS (SELECT account, 1.0::DOUBLE AS pam, gm AS grouped_materials, gd AS grouped_drugs, gen AS generic, db AS day_bed, ho AS hotel, fo AS food, (n = 0)::INT::DOUBLE AS no_coverage, (db > 0 AND NOT h AND a)::INT::DOUBLE AS mismatch, rep AS repetition, vf AS val_fees, vs AS val_surgery, 1 - gd AS val_drugs, 1 - gm AS val_materials FROM cov JOIN bl USING (account) JOIN rp USING (account) JOIN pm USING (account))"""


def signals(spark, sf):
    return S.account_signals(star.settlement_lines(spark, sf), star.described(spark, sf), coverage(spark, sf))


@query("a24_account_signals", f"WITH {SIG} SELECT * FROM sg")
def a24(spark, sf):
    return signals(spark, sf)


CL = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {}))"
HYP = f"""{SIG}, h1 AS (SELECT *, CASE WHEN generic * 0.40::DOUBLE + grouped_materials * 0.35::DOUBLE + grouped_drugs * 0.35::DOUBLE > 0.6::DOUBLE THEN 'OPACO' ELSE 'DETALLADO' END AS state FROM sg),
  h2 AS (SELECT *, {CL.format("CASE WHEN state = 'OPACO' THEN generic * 0.15::DOUBLE + 0.85::DOUBLE ELSE 0.2::DOUBLE END")} AS op, {CL.format('day_bed * 0.4::DOUBLE + 0.2::DOUBLE + hotel * 0.2::DOUBLE + food * 0.2::DOUBLE')} AS ub, {CL.format('no_coverage * 0.5::DOUBLE + 0.2::DOUBLE + mismatch * 0.3::DOUBLE')} AS inc, {CL.format('generic * 0.5::DOUBLE + 0.15::DOUBLE + repetition * 0.2::DOUBLE + hotel * 0.15::DOUBLE')} AS irr FROM h1),
  h3 AS (SELECT *, {CL.format('irr * 0.45::DOUBLE + 0.05::DOUBLE + ub * 0.35::DOUBLE - op * 0.30::DOUBLE')} AS fr, {CL.format('irr * 0.6::DOUBLE + 0.1::DOUBLE + hotel * 0.3::DOUBLE')} AS tec, {CL.format('0.9::DOUBLE - generic * 0.35::DOUBLE - hotel * 0.25::DOUBLE - no_coverage * 0.25::DOUBLE - irr * 0.2::DOUBLE')} AS ok FROM h2),
  hy AS (SELECT *, CASE WHEN op > 0.8 THEN fr * 0.4::DOUBLE ELSE fr END AS fr2, CASE WHEN op > 0.8 THEN ub * 0.5::DOUBLE ELSE ub END AS ub2 FROM h3)"""


@query("a25_hypotheses", f"WITH {HYP} SELECT account, state, op AS OPACIDAD, ub2 AS UNBUNDLING, inc AS INCUMPLIMIENTO, irr AS IRREGULAR, fr2 AS FRAUDE, tec AS TECNICO, ok AS OK FROM hy")
def a25(spark, sf):
    return S.hypotheses(signals(spark, sf)).select("account", "state", *S.HYPOTHESES)


@query("o06_ranked_hypotheses", f"""WITH {HYP}, u AS (SELECT account, unnest([{{'h': 'OPACIDAD', 'i': 0, 'v': op}}, {{'h': 'UNBUNDLING', 'i': 1, 'v': ub2}}, {{'h': 'INCUMPLIMIENTO', 'i': 2, 'v': inc}}, {{'h': 'IRREGULAR', 'i': 3, 'v': irr}}, {{'h': 'FRAUDE', 'i': 4, 'v': fr2}}, {{'h': 'TECNICO', 'i': 5, 'v': tec}}, {{'h': 'OK', 'i': 6, 'v': ok}}]) AS x FROM hy)
  SELECT account, CAST(row_number() OVER (PARTITION BY account ORDER BY round(x.v, 9) DESC, x.i) AS INT) AS rank, x.h AS hypothesis, round(x.v, 9) AS confidence FROM u""")
def o06(spark, sf):
    return S.ranked_hypotheses(S.hypotheses(signals(spark, sf)))


ACT = f"""{HYP}, oc AS (SELECT account, CAST(coalesce(sum(copago) FILTER (WHERE regexp_matches(description, 'MATERIALES|MEDICAMENTOS|INSUMOS|SUMINISTROS') OR {rx('description', 'agrup|consolid|generico|varios|total')}), 0) AS BIGINT) AS opaque, CAST(sum(copago) AS BIGINT) AS copago FROM lines GROUP BY account),
  ac0 AS (SELECT hy.*, opaque, copago, list_filter([CASE WHEN state = 'OPACO' AND NOT (copago > 0 AND opaque::DOUBLE / copago < 0.15) THEN 'OPACIDAD' END, CASE WHEN ub2 > 0.6 THEN 'UNBUNDLING' END, CASE WHEN inc > 0.6 THEN 'INCUMPLIMIENTO' END, CASE WHEN irr > 0.65 THEN 'IRREGULAR' END, CASE WHEN fr2 > 0.8 AND irr > 0.75 AND ub2 > 0.65 THEN 'FRAUDE' END, CASE WHEN tec > 0.6 THEN 'TECNICO' END], lambda x: x IS NOT NULL) AS act FROM hy JOIN oc USING (account)),
  ac AS (SELECT *, CASE WHEN len(act) = 0 AND ok >= greatest(op, ub2, inc, irr, fr2, tec) THEN ['OK'] ELSE act END AS active FROM ac0)"""


def active(spark, sf):
    return S.active_hypotheses(S.hypotheses(signals(spark, sf)), S.opaque_copago(star.settlement_lines(spark, sf)))


@query("a25_active_hypotheses", f"WITH {ACT} SELECT account, state, opaque, copago, active, op AS opacity_confidence FROM ac")
def a25b(spark, sf):
    return active(spark, sf)


SF = f"""{ACT}, ht AS (SELECT account, CAST(coalesce(sum(copago) FILTER (WHERE {rx('description', S.HOTEL + '|' + S.FOOD)}), 0) AS BIGINT) AS hotel, bool_or({rx('description', S.HOTEL_SURE)}) AS sure FROM described GROUP BY account), aj AS (SELECT ac.account, state, opaque, copago, active, ht.hotel, sure FROM ac JOIN ht USING (account)),
  sfd AS (SELECT account, 'MATERIALES/MEDICAMENTOS SIN APERTURA' AS label, 'B' AS category, opaque AS amount FROM aj WHERE state = 'OPACO' AND opaque > 0 UNION ALL SELECT account, 'HOTELERIA / ALIMENTACION COBRADA APARTE (UNBUNDLING)', 'A', hotel FROM aj WHERE list_contains(active, 'UNBUNDLING') AND hotel > 0 AND sure UNION ALL SELECT account, 'POSIBLE HOTELERIA/ALIMENTACION', 'B', hotel FROM aj WHERE list_contains(active, 'UNBUNDLING') AND hotel > 0 AND NOT sure AND NOT list_contains(active, 'OPACIDAD'))"""


@query("a26_structural_findings", f"WITH {SF} SELECT * FROM sfd")
def a26(spark, sf):
    return S.structural_findings(active(spark, sf), star.described(spark, sf))


@query("a26_global_decision", f"""WITH {SF}, s AS (SELECT account, sum(amount) FILTER (WHERE category = 'A') AS a FROM sfd GROUP BY account) SELECT ac.account, CASE WHEN list_contains(active, 'FRAUDE') AND coalesce(a, 0) / greatest(copago, 1) > 0.25 THEN 'PATRON_COMPATIBLE_CON_FRAUDE_PROBABLE' WHEN list_contains(active, 'IRREGULAR') AND list_contains(active, 'OPACIDAD') THEN 'PRACTICAS_IRREGULARES_CON_OPACIDAD_ESTRUCTURAL' WHEN list_contains(active, 'OPACIDAD') THEN 'COPAGO_INDETERMINADO_PARCIAL_POR_OPACIDAD' ELSE 'AUDITORIA_CONCLUIDA' END AS decision FROM ac LEFT JOIN s USING (account)""")
def a26b(spark, sf):
    from saldo.operators import reports
    act = active(spark, sf)
    return S.global_decision(act, reports.category_sums(S.structural_findings(act, star.described(spark, sf))))


SCOPED = f"""{DESCRIBED}, {LINES_ONLY}, {ACCOUNTS}, ni AS (SELECT account, count(*) AS n FROM described GROUP BY account), nl AS (SELECT account, count(*) AS m FROM lines GROUP BY account),
  pe AS (SELECT account, section, count(*) FILTER (WHERE total < 15000) AS cheap, count(*) FILTER (WHERE {rx('description', 'aposito|sutura|hoja|bisturi|guante|jeringa|aguj|cateter|sonda|compres|gasas')}) AS words, count(*) FILTER (WHERE {rx('description', 'calcetin|media|toalla|agua|botella|termometro|vaso|jabon|shampoo|kit|confort')}) AS comfort FROM described GROUP BY ALL),
  hp AS (SELECT account, 'H1_OPACIDAD' AS hypothesis, 'PAM_LINE' AS scope_type, line_id AS scope_key, 0.85::DOUBLE AS confidence FROM lines JOIN ni USING (account) JOIN nl USING (account) WHERE n >= 5 AND m <= 10 AND {rx('description', 'material|insumo|medicamento|varios|sin bonific')}
   UNION ALL SELECT account, 'H2_UNBUNDLING', 'SECTION', section, 0.8 FROM pe WHERE {rx('section', 'pabellon|quirurg|intervencion|cirugia|honorario')} AND (cheap > 8 OR words > 3) UNION ALL SELECT account, 'H3_HOTELERIA', 'SECTION', section, 0.9 FROM pe WHERE comfort > 0 UNION ALL SELECT account, 'H5_TEST_CASE', 'GLOBAL', '', 0.99 FROM accounts WHERE priority = '5-LOW')"""


def scoped(spark, sf):
    test = star.accounts(spark, sf).filter("priority = '5-LOW'")
    return S.scoped_hypotheses(star.settlement_lines(spark, sf), star.described(spark, sf), test, min_items=5)


@query("a27_scoped_hypotheses", f"WITH {SCOPED} SELECT * FROM hp")
def a27(spark, sf):
    return scoped(spark, sf)


@query("j27_capability_gate", f"""WITH {SCOPED}, bk AS (SELECT account, scope_type, scope_key FROM hp WHERE hypothesis IN ('H5_TEST_CASE', 'H1_OPACIDAD')), en AS (SELECT account, scope_type, scope_key FROM hp WHERE hypothesis = 'H2_UNBUNDLING'),
  sc AS (SELECT account, 'PAM_LINE' AS scope_type, line_id AS scope_key FROM lines UNION ALL SELECT DISTINCT account, 'SECTION', section FROM described)
  SELECT sc.*, NOT EXISTS (SELECT 1 FROM bk WHERE bk.account = sc.account AND (bk.scope_type = 'GLOBAL' OR (bk.scope_type = sc.scope_type AND bk.scope_key = sc.scope_key))) AND EXISTS (SELECT 1 FROM en WHERE en.account = sc.account AND en.scope_type = sc.scope_type AND en.scope_key = sc.scope_key) AS allowed FROM sc""")
def j27(spark, sf):
    lines = star.settlement_lines(spark, sf).select("account", F.lit("PAM_LINE").alias("scope_type"), F.col("line_id").alias("scope_key"))
    sections = star.described(spark, sf).select("account", F.lit("SECTION").alias("scope_type"), F.col("section").alias("scope_key")).distinct()
    return S.allowed(lines.unionByName(sections), S.capabilities(scoped(spark, sf)), "UNBUNDLING_IF319")


LABS = ", ".join(f"count(*) FILTER (WHERE contains(description, '{k}')) > 4" for k in lx.LAB_MARKERS)
FLG = f"""{DESCRIBED}, pr AS (SELECT account, bool_or(p) AS f01 FROM (SELECT account, description, min(unit_price) <> max(unit_price) AS p FROM described GROUP BY ALL) GROUP BY account),
  fg AS (SELECT account, count(*) FILTER (WHERE contains(description, 'VISITA')) AS v, len(list_filter([{LABS}], lambda x: x)) AS labs, bool_or(contains(description, 'AMPLIACION')) AS f04 FROM described GROUP BY account),
  fl AS (SELECT account, f01, v > 5 AS f02, labs > 0 AS f03, f04, f01 OR v > 10 OR labs > 2 OR f04 AS high_risk FROM fg JOIN pr USING (account))"""


@query("a20_account_flags", f"WITH {FLG} SELECT * FROM fl")
def a20(spark, sf):
    return S.account_flags(star.described(spark, sf))


RUL = f"""{FLG}, {ACCOUNTS}, {RULES}, {COVER}, ri AS (SELECT account, bool_or(regexp_matches(description, 'DIA CAMA|NOCHE CAMA|HABITACION|SALA DE')) AS stay, bool_or(regexp_matches(description, 'DER\\.PABELLON|DERECHO (DE )?PABELLON|RECUPERACION')) AS room,
  bool_or(regexp_matches(description, 'HM-|CIRU|AYUD|ANEST') AND NOT regexp_matches(description, 'DER.PAB|DERECHO PAB|EQUIPO PAB') AND NOT contains(description, 'VISITA')) AS fees, count(*) FILTER (WHERE regexp_matches(description, 'MEDIC|INSUMO|SOL\\.|AMP ')) AS drugs FROM described GROUP BY account),
  rl AS (SELECT account, n = 0 AS c01, (room AND NOT fees) OR (stay AND NOT h) AS c02, a AND drugs > 50 AS c03, account % 5 = 0 AS c04 FROM ri JOIN cov USING (account))"""


def canonical_rules(spark, sf):
    con = coverage(spark, sf).withColumn("per_event", F.col("ambulatory_cover"))
    unc = star.accounts(spark, sf).select("account", (F.col("account") % 5 == 0).alias("uncomputable"))
    return S.account_rules(star.described(spark, sf), con, unc)


@query("p48_account_rules", f"WITH {RUL} SELECT * FROM rl")
def p48(spark, sf):
    return canonical_rules(spark, sf)


@query("p49_rules_decision", f"WITH {RUL} SELECT account, CASE WHEN c04 THEN 'COPAGO_INDETERMINADO_POR_OPACIDAD' WHEN c01 OR c02 OR c03 THEN 'ERROR_CONTRATO_PROBADO' WHEN high_risk THEN 'ZONA_GRIS_REQUIERE_ANTECEDENTES' ELSE 'OK_VERIFICABLE' END AS decision FROM rl JOIN fl USING (account)")
def p49(spark, sf):
    return S.rules_decision(canonical_rules(spark, sf), S.account_flags(star.described(spark, sf)))


@query("a29_account_anchors", f"WITH {DESCRIBED}, {ANCHORS} SELECT * FROM anchors")
def a29(spark, sf):
    return S.account_anchors(star.described(spark, sf))


OPL = "ol AS (SELECT account, account || ':' || page AS line_id, CASE folio WHEN 'AF' THEN '3101001' WHEN 'AO' THEN '31.010-01' WHEN 'RF' THEN '3201001' WHEN 'RO' THEN '3101001' ELSE '1103057' END AS code, bonif, copago, replace(replace(CASE folio WHEN 'AF' THEN '3101001' WHEN 'AO' THEN '31.010-01' WHEN 'RF' THEN '3201001' WHEN 'RO' THEN '3101001' ELSE '1103057' END, '.', ''), '-', '') AS k FROM charges)"


@query("a31_opacity_declarations", f"""WITH {CHARGES}, {OPL}, pd AS (SELECT account, k, bool_or(bonif > 0) AS paid FROM ol GROUP BY ALL), j AS (SELECT * FROM ol JOIN pd USING (account, k) WHERE copago > 0)
  SELECT account, line_id, copago, 1 AS "type" FROM j WHERE k = '3101001' AND bonif = 0 UNION ALL SELECT account, line_id, copago, 2 FROM j WHERE k = '3201001' UNION ALL SELECT account, line_id, copago, 3 FROM j WHERE k IN ('3101001', '3201001') AND bonif = 0 AND paid""")
def a31(spark, sf):
    code = K.lookup(F.col("folio"), {"AF": "3101001", "AO": "31.010-01", "RF": "3201001", "RO": "3101001"}, "1103057")
    lines = star.charges(spark, sf).select("account", F.concat_ws(":", F.col("account").cast("string"), F.col("page").cast("string")).alias("line_id"), code.alias("code"), "bonif", "copago")
    return S.opacity_declarations(lines)


@query("g02_declarations_per_type", f"""WITH {CHARGES}, {OPL}, pd AS (SELECT account, k, bool_or(bonif > 0) AS paid FROM ol GROUP BY ALL), j AS (SELECT * FROM ol JOIN pd USING (account, k) WHERE copago > 0),
  t AS (SELECT 1 AS "type", copago FROM j WHERE k = '3101001' AND bonif = 0 UNION ALL SELECT 2, copago FROM j WHERE k = '3201001' UNION ALL SELECT 3, copago FROM j WHERE k IN ('3101001', '3201001') AND bonif = 0 AND paid) SELECT "type", count(*) AS n, CAST(sum(copago) AS BIGINT) AS copago FROM t GROUP BY 1""")
def g02(spark, sf):
    return a31(spark, sf).groupBy("type").agg(F.count("*").alias("n"), F.sum("copago").alias("copago"))


@query("a32_exposed_amount", f"""WITH {ETI}, {ACCOUNTS}, g AS (SELECT account, count(*) FILTER (WHERE etype <> 'CORRECTO') AS fl, coalesce(sum(total) FILTER (WHERE etype <> 'CORRECTO'), 0) AS am, sum(total) AS it FROM eti GROUP BY account)
  SELECT account, fl + CASE WHEN priority = '1-URGENT' THEN 1 ELSE 0 END AS flagged, CAST(greatest(0, stated_total - it) AS BIGINT) AS residual, CAST(am + greatest(0, stated_total - it) + CASE WHEN priority = '1-URGENT' THEN 1000 ELSE 0 END AS BIGINT) AS exposed FROM g JOIN accounts USING (account)""")
def a32(spark, sf):
    acc = star.accounts(spark, sf)
    single = acc.filter("priority = '1-URGENT'").select("account", F.lit(1).cast("long").alias("events"), F.lit(1000).cast("long").alias("addition"))
    return S.exposed_amount(explained(spark, sf), acc.select("account", "stated_total"), single)


@query("a33_section_tree", f"""WITH {ITEMS}, t AS (SELECT account, pos, section, subfamily FROM items JOIN (SELECT DISTINCT account, part, section, subfamily FROM ({'WITH ' + TAX + ' SELECT * FROM tax'})) USING (account, part, section)), l AS (SELECT account, section, subfamily, min(pos) AS subfamily_first, count(*) AS n FROM t GROUP BY ALL)
  SELECT account, section, min(subfamily_first) OVER (PARTITION BY account, section) AS section_first, CAST(sum(n) OVER (PARTITION BY account, section) AS BIGINT) AS section_n, subfamily, subfamily_first, n FROM l""")
def a33(spark, sf):
    return S.section_tree(star.numbered(taxed(spark, sf)))


RALLY = f"{LINES}, rl AS (SELECT *, coalesce({COST_SQL.replace('section', chr(39) + 'PAM' + chr(39))}, 'IV') AS k FROM lines WHERE copago > 0)"


@query("a28_rally_totals", f"""WITH {RALLY}, g AS (SELECT account, {', '.join(f"CAST(coalesce(sum(copago) FILTER (WHERE k = '{n}'), 0) AS BIGINT) AS {n}" for n in ('I', 'II', 'III', 'IV'))}, CAST(sum(copago) AS BIGINT) AS total FROM rl GROUP BY account), s AS (SELECT account, CAST(sum(copago) AS BIGINT) + account % 9 AS stated FROM lines GROUP BY account)
  SELECT account, I, II, III, IV, total, CASE WHEN abs(total - stated) < 5 THEN 0 ELSE total - stated END AS delta, I + II AS confirmed, III + IV AS disputed, IV AS indeterminate FROM g JOIN s USING (account)""")
def a28(spark, sf):
    lines = star.settlement_lines(spark, sf)
    stated = lines.groupBy("account").agg((F.sum("copago") + F.col("account") % 9).alias("stated"))
    return S.rally_totals(lines, stated)


@query("o04_lines_by_amount", f"WITH {RALLY} SELECT account, k AS cost_class, row_number() OVER (PARTITION BY account, k ORDER BY copago DESC, line_id) AS n, line_id, copago FROM rl")
def o04(spark, sf):
    return S.rally_lines(star.settlement_lines(spark, sf))
