"""Precedents, doctrine, tiered decisions and finding relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ACCOUNTS, CHARGES, DESCRIBED, ITEMS, LINES, LINES_ONLY, RULES
from saldo.catalog.registry import query
from saldo.catalog.reports import LINE_FINDS, line_findings
from saldo.functions import lexicon as lx
from saldo.functions.text import any_of
from saldo.operators import classify as K
from saldo.operators import decisions as D
from saldo.operators.texts import kinds, with_kinds
from saldo.sources import star

U = "upper(description)"
KIND = f"CASE WHEN regexp_matches({U}, 'MEDIC|FARMAC|DROGA') THEN 'MED' WHEN contains({U}, 'MATER') THEN 'MAT' WHEN contains({U}, 'INSUM') THEN 'INS' WHEN regexp_matches({U}, 'VARIOS|OTROS|MISCELAN') THEN 'VAR' ELSE 'OTRO' END"
GEN = f"regexp_matches({U}, 'MATERIAL|MEDICAMENTO|INSUMO|VARIOS|PRESTACIONES SIN BONIF')"
FACT = f"sha1(concat_ws(chr(31), code, {KIND}, CAST((bonif = 0)::INT AS VARCHAR), CAST((copago > 0)::INT AS VARCHAR), CAST({GEN}::INT AS VARCHAR)))"
HOT = f"regexp_matches({U}, 'ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION|CONFORT|KIT DE ASEO|PANTUFLAS|ROPA|MANTENCION|ESTACIONAMIENTO|TELEVISION|WIFI')"
FEAT = f"""{LINES}, ft0 AS (SELECT *, contract_id, provider % 4 = 0 AS fullc, provider % 3 = 0 AS expl, {KIND} AS kind, {GEN} AS gen, {HOT} AS hot, regexp_matches({U}, 'ENFERMERIA|CURACION|ANESTESIA|PROPOFOL') AS inc, code LIKE '03%' OR regexp_matches({U}, 'EXAMEN|LABORATORIO|RADIOLOG|BIOPSIA|HEMOGRAMA|CULTIVO|PERFIL|ORINA|SANGRE') AS exam,
    regexp_matches({U}, 'NO CUBIERTO|PRESTACION NO CONTEMPLADA|SIN BONIF|SIN COBERTURA|EXCLUIDO') AND regexp_matches({U}, 'HONORARIO|PABELLON|ANESTESIA|MEDICAMENTO|INSUMO|MATERIAL CLINICO') AS rel FROM lines JOIN accounts USING (account)),
  ft1 AS (SELECT *, (fullc OR (kind IN ('MED', 'MAT', 'INS') AND expl) OR rel) AND copago > 0 AS breach, gen AND copago > 0 AS opl FROM ft0),
  ft AS (SELECT *, list_filter([CASE WHEN bonif = 0 THEN 'BONIF_0' END, CASE WHEN copago > 0 THEN 'COPAGO_POS' END, CASE WHEN gen THEN 'GENERIC_PAM_LINE' END, CASE WHEN inc THEN 'INHERENTLY_INCLUDED' END, CASE WHEN hot THEN 'ES_HOTELERIA' END, CASE WHEN exam THEN 'ES_EXAMEN' END, CASE WHEN rel THEN 'STRATEGIC_RECLASSIFICATION' END, CASE WHEN kind IN ('MED', 'INS') THEN 'MED_OR_INS' END,
    CASE WHEN expl THEN 'COV_EXPLICIT' END, CASE WHEN fullc THEN 'COV_100' END, CASE WHEN breach THEN 'IC_BREACH' END, CASE WHEN inc THEN 'UB_DETECTED' END, CASE WHEN hot THEN 'HT_DETECTED' END, CASE WHEN opl THEN 'OPACIDAD_LINEA' END, CASE WHEN opl AND NOT breach AND NOT inc AND NOT hot THEN 'OP_DETECTED' END], lambda x: x IS NOT NULL) AS features,
    {FACT} AS fact_hash, contract_id AS contract_hash FROM ft1)""".replace("ft0 AS", f"{ACCOUNTS}, ft0 AS", 1).replace("SELECT *, contract_id, provider", "SELECT lines.*, contract_id, provider", 1)
PREC = """pre AS (SELECT DISTINCT contract_hash, fact_hash, 'P-' || code || '-' || k AS id, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Z' END AS category, 0.7::DOUBLE + k * 0.1::DOUBLE AS confidence, CASE k WHEN 0 THEN [] WHEN 1 THEN ['COV_EXPLICIT'] ELSE ['BONIF_0', 'COV_100'] END AS requires, CASE k WHEN 2 THEN ['ES_EXAMEN'] ELSE [] END AS forbids FROM ft, (SELECT unnest([0, 1, 2]) AS k) WHERE contract_hash IN ('ASIA', 'EUROPE'))"""
LOOK = f"{FEAT}, {PREC}, hit AS (SELECT ft.line_id, id, category, confidence, row_number() OVER (PARTITION BY line_id ORDER BY confidence DESC, id) AS r FROM ft JOIN pre USING (contract_hash, fact_hash) WHERE list_has_all(features, requires) AND NOT list_has_any(features, forbids))"


# What the rules look at in a line; amounts by their sign alone.
KIND_KEYS = ["contract_hash", "code", "description", "bonif_sign", "copago_sign", "full_cover", "explicit"]


def contracted(spark, sf):
    """Lines with their contract and kind; the contract hash is the contract's name here."""
    lines = star.settlement_lines(spark, sf).join(star.accounts(spark, sf).select("account", F.col("contract_id").alias("contract_hash")), "account")
    sign = lambda c: F.signum(c).cast("int")
    return lines.withColumns({"bonif_sign": sign("bonif"), "copago_sign": sign("copago"), "full_cover": F.col("provider") % 4 == 0, "explicit": F.col("provider") % 3 == 0})


def featured_kinds(lines):
    """Kinds of lines with features and hashes."""
    c = F.col
    return kinds(lines, KIND_KEYS).withColumns({
        "features": K.line_features(c("code"), c("description"), c("bonif_sign"), c("copago_sign"), c("full_cover"), c("explicit")),
        "fact_hash": D.line_fingerprint(c("code"), c("description"), c("bonif_sign"), c("copago_sign"))})


def featured(spark, sf):
    """Lines with features and hashes."""
    lines = contracted(spark, sf)
    return with_kinds(lines, featured_kinds(lines), KIND_KEYS)


def precedents(known):
    """Precedents of the facts that lines, or kinds of lines, hold."""
    f = known.filter(F.col("contract_hash").isin("ASIA", "EUROPE")).select("contract_hash", "fact_hash", "code").distinct()
    k = F.col("k")
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    return f.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "contract_hash", "fact_hash", F.concat(F.lit("P-"), "code", F.lit("-"), k.cast("string")).alias("id"), F.when(k == 0, "A").when(k == 1, "B").otherwise("Z").alias("category"),
        (F.lit(0.7) + k * 0.1).alias("confidence"), F.when(k == 0, arr()).when(k == 1, arr("COV_EXPLICIT")).otherwise(arr("BONIF_0", "COV_100")).alias("requires"),
        F.when(k == 2, arr("ES_EXAMEN")).otherwise(arr()).alias("forbids"))


def looked_up(lines):
    """Kinds of lines with features, hashes and their precedent."""
    known = featured_kinds(lines)
    return D.precedent_lookup(known, precedents(known))


@query("f25_line_features", f"WITH {FEAT} SELECT line_id, features, fact_hash FROM ft")
def f25(spark, sf):
    return featured(spark, sf).select("line_id", "features", "fact_hash")


@query("j20_precedent_lookup", f"WITH {LOOK} SELECT ft.line_id, id AS precedent, category AS precedent_category, confidence AS precedent_confidence FROM ft LEFT JOIN hit ON hit.line_id = ft.line_id AND r = 1")
def j20(spark, sf):
    lines = contracted(spark, sf)
    return with_kinds(lines, looked_up(lines), KIND_KEYS).select("line_id", "precedent", "precedent_category", "precedent_confidence")


DOC = "CASE WHEN list_contains(features, 'IC_BREACH') THEN 'C01_INCUMPLIMIENTO_CONTRATO' WHEN list_contains(features, 'UB_DETECTED') THEN 'C02_UNBUNDLING' WHEN list_contains(features, 'HT_DETECTED') THEN 'C03_INFERENCIA_TECNICA' WHEN list_contains(features, 'OP_DETECTED') THEN 'C05_OPACIDAD_REAL' END"


@query("j21_doctrine", f"WITH {FEAT} SELECT line_id, {DOC} AS rule, list_filter([CASE WHEN list_contains(features, 'IC_BREACH') THEN 'C01_INCUMPLIMIENTO_CONTRATO' END, CASE WHEN list_contains(features, 'UB_DETECTED') THEN 'C02_UNBUNDLING' END, CASE WHEN list_contains(features, 'HT_DETECTED') THEN 'C03_INFERENCIA_TECNICA' END, CASE WHEN list_contains(features, 'OP_DETECTED') THEN 'C05_OPACIDAD_REAL' END], lambda x: x IS NOT NULL) AS every FROM ft")
def j21(spark, sf):
    return featured(spark, sf).select("line_id", D.doctrine(F.col("features"))["rule"].alias("rule"), D.all_doctrine(F.col("features")).alias("every"))


def fees(spark, sf):
    l = star.settlement_lines(spark, sf)
    p = F.col("provider")
    return l.filter("folio like 'N%'").select("account", "code", (F.col("copago") + p % 900).alias("copago"), F.concat(F.lit("HONORARIO: "), "description").alias("description"), F.when(F.col("folio") == "NF", "A").otherwise("OK").alias("category"), F.col("line_id").alias("fee_id"))


FEE = "fee AS (SELECT account, code, copago + provider % 900 AS fc, 'HONORARIO: ' || description AS d, CASE folio WHEN 'NF' THEN 'A' ELSE 'OK' END AS category, line_id AS fee_id FROM lines WHERE folio LIKE 'N%'), fe AS (SELECT l.account, l.line_id, arg_max(fee.category, fee_id) AS financial_category FROM lines l JOIN fee ON fee.account = l.account AND fee.code = l.code AND abs(fc - l.copago) < 500 AND contains(d, substr(l.description, 1, 10)) GROUP BY ALL)"


@query("j23_fee_evidence", f"WITH {LINES}, {FEE} SELECT * FROM fe")
def j23(spark, sf):
    return D.fee_evidence(star.settlement_lines(spark, sf), fees(spark, sf))


DEC = f"""{LOOK}, {FEE}, dc0 AS (SELECT ft.*, financial_category, hit.id AS pid, hit.category AS pc, hit.confidence AS pv, {DOC} AS doc FROM ft LEFT JOIN fe USING (account, line_id) LEFT JOIN hit ON hit.line_id = ft.line_id AND r = 1),
  dc AS (SELECT *, CASE WHEN financial_category IS NOT NULL THEN financial_category WHEN pid IS NOT NULL THEN pc WHEN doc = 'C05_OPACIDAD_REAL' THEN 'Z' WHEN doc IS NOT NULL THEN 'A' WHEN copago > 0 AND (bonif = 0 OR gen) THEN 'B' ELSE 'Z' END AS category, CASE WHEN financial_category IS NOT NULL THEN 0.99 WHEN pid IS NOT NULL THEN pv WHEN doc LIKE 'C01%' THEN 1.0 WHEN doc LIKE 'C02%' THEN 0.95 WHEN doc LIKE 'C03%' THEN 0.9 WHEN doc LIKE 'C05%' THEN 0.85 WHEN copago > 0 AND bonif = 0 THEN 0.65 WHEN copago > 0 AND gen THEN 0.6 ELSE 0.5 END::DOUBLE AS confidence,
    CASE WHEN financial_category IS NOT NULL THEN 'FINANCIERO' WHEN pid IS NOT NULL THEN 'PRECEDENTE' WHEN doc IS NOT NULL THEN 'DOCTRINA' ELSE 'HEURISTICA' END AS source FROM dc0)"""


def decided(spark, sf):
    lines = contracted(spark, sf)
    f = with_kinds(lines, D.tiered(looked_up(lines)), KIND_KEYS)
    e = D.fee_evidence(star.settlement_lines(spark, sf), fees(spark, sf)).select("line_id", "financial_category")
    return D.evidence_first(f.join(e, "line_id", "left"))


@query("j22_tiered_decision", f"WITH {DEC} SELECT line_id, category, confidence, source FROM dc")
def j22(spark, sf):
    return decided(spark, sf).select("line_id", "category", "confidence", "source")


@query("j28_frozen_override", f"WITH {DEC} SELECT line_id, CASE WHEN source IN ('PRECEDENTE', 'DOCTRINA') THEN category ELSE 'B' END AS category, source IN ('PRECEDENTE', 'DOCTRINA') AS was_frozen FROM dc")
def j28(spark, sf):
    d = decided(spark, sf)
    later = star.settlement_lines(spark, sf).select("account", "line_id", F.lit("B").alias("category"))
    return D.override(later, D.freeze(d)).select("line_id", "category", F.col("frozen").isNotNull().alias("was_frozen"))


@query("a47_learnable", f"WITH {DEC} SELECT contract_hash, fact_hash, max(confidence) AS confidence, count(*) AS lines FROM dc WHERE category = 'A' AND confidence >= 0.85 AND source = 'DOCTRINA' GROUP BY ALL")
def a47(spark, sf):
    return D.learnable(decided(spark, sf))


@query("a47_precedent_stats", f"WITH {LOOK} SELECT category, count(*) AS n FROM pre GROUP BY category")
def a47b(spark, sf):
    return D.precedent_stats(precedents(featured_kinds(contracted(spark, sf))))


@query("j24_not_flagged", f"WITH {LINES}, f AS (SELECT account, CASE WHEN provider % 3 = 0 THEN line_id END AS fl, CASE WHEN provider % 3 = 1 THEN description END AS label, CASE WHEN provider % 3 = 2 THEN code END AS code FROM lines WHERE copago * 20 > valor) SELECT l.line_id FROM lines l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.account = l.account AND (f.fl = l.line_id OR f.label = l.description OR f.code = l.code))")
def j24(spark, sf):
    l = star.settlement_lines(spark, sf)
    p = F.col("provider") % 3
    f = l.filter("copago * 20 > valor").select("account", F.when(p == 0, F.col("line_id")).alias("finding_line"), F.when(p == 1, F.col("description")).alias("label"), F.when(p == 2, F.col("code")).alias("code"))
    return D.not_flagged(l, f).select("line_id")


OTH = "ot AS (SELECT provider AS account, label, amount + provider % 3 * 60 AS amount FROM (SELECT provider, description AS label, copago AS amount FROM lines WHERE folio LIKE '%F'))"


@query("j25_suppress_overlaps", f"WITH {LINES}, {OTH}, f AS (SELECT provider AS account, description AS label, copago AS amount, line_id FROM lines) SELECT line_id FROM f WHERE NOT EXISTS (SELECT 1 FROM ot WHERE ot.account = f.account AND ot.label = f.label AND abs(ot.amount - f.amount) < 100)")
def j25(spark, sf):
    l = star.settlement_lines(spark, sf)
    f = l.select(F.col("provider").alias("account"), F.col("description").alias("label"), F.col("copago").alias("amount"), "line_id")
    o = l.filter("folio like '%F'").select(F.col("provider").alias("account"), F.col("description").alias("label"), (F.col("copago") + F.col("provider") % 3 * 60).alias("amount"))
    return D.suppress_overlaps(f, o).select("line_id")


@query("j26_findings_of_lines", f"""WITH {LINES}, {LINE_FINDS}, f AS (SELECT account, line_id AS finding_id, label, CASE WHEN category = 'A' THEN line_id END AS lk FROM lf), r AS (SELECT * FROM (VALUES ('material', 'material|insumo'), ('medicamento', 'medicamento|farmac'), ('honorario', 'honorario|medico'), ('sin_bonif', 'sin bonif|prestacion.*bonif')) t(k, w))
  SELECT account, finding_id, lk AS line_id FROM f WHERE lk IS NOT NULL UNION SELECT f.account, finding_id, l.line_id FROM f JOIN r ON regexp_matches(lower(label), w) JOIN lines l ON l.account = f.account AND contains(lower(l.description), k) WHERE lk IS NULL""")
def j26(spark, sf):
    f = line_findings(spark, sf).select("account", F.col("line_id").alias("finding_id"), "label", F.when(F.col("category") == "A", F.col("line_id")).alias("line_key"))
    return D.findings_of_lines(f, star.settlement_lines(spark, sf))


@query("u01_union_of_sources", f"WITH {LINES}, {LINE_FINDS} SELECT source, precedence, count(*) AS n FROM (SELECT 'doctrine' AS source, 0 AS precedence FROM lf UNION ALL SELECT 'structural', 1 FROM lines WHERE code LIKE '320%') GROUP BY ALL")
def u01(spark, sf):
    a = line_findings(spark, sf)
    b = star.settlement_lines(spark, sf).filter("code like '320%'").select("account", F.col("description").alias("label"), F.col("copago").alias("amount"))
    return D.union_sources([("doctrine", a), ("structural", b)]).groupBy("source", "precedence").agg(F.count("*").alias("n"))


@query("j30_generic_charge_trace", f"""WITH {ITEMS}, {LINES_ONLY}, g AS (SELECT account, item_id, total FROM items WHERE (regexp_matches(description, 'AJUSTE|VARIO|DIFERENCIA|SUMINISTRO|CARGO ADMIN|OTROS|INSUMOS') OR regexp_matches(code, '^(14|02|99)\\d+')) AND total >= 1000),
  a AS (SELECT g.account, item_id, min(line_id) AS line_id FROM g JOIN lines l ON l.account = g.account AND abs(l.bonif - g.total) <= 1000 GROUP BY ALL), b AS (SELECT g.account, item_id, min(folio) AS folio FROM g JOIN lines l ON l.account = g.account AND abs(l.bonif - g.total) <= 2000 GROUP BY ALL)
  SELECT g.account, g.item_id, g.total, CASE WHEN a.line_id IS NOT NULL THEN 'LINEA' WHEN b.folio IS NOT NULL THEN 'FOLIO' ELSE 'SIN_CORRELACION' END AS traced, a.line_id, CASE WHEN a.line_id IS NULL THEN b.folio END AS folio FROM g LEFT JOIN a USING (account, item_id) LEFT JOIN b USING (account, item_id)""")
def j30(spark, sf):
    return D.trace_generic_charges(star.bill_items(spark, sf), star.settlement_lines(spark, sf))


@query("j31_nutrition_targets", f"WITH {LINES}, t AS (SELECT account, line_id, copago AS valor, row_number() OVER (PARTITION BY account ORDER BY copago DESC, line_id DESC) AS r FROM lines WHERE bonif = 0 AND copago > 0) SELECT account, line_id, valor FROM t WHERE r = 1")
def j31(spark, sf):
    return D.nutrition_targets(_food_lines(spark, sf))


def _food_lines(spark, sf):
    l = star.settlement_lines(spark, sf)
    return l.withColumn("description", F.when(F.col("bonif") == 0, F.lit("PRESTACIONES SIN BONIFICACION")).otherwise(F.col("description")))


@query("j31_nutrition_match", f"""WITH RECURSIVE {ITEMS}, {LINES_ONLY}, r AS (SELECT account, line_id, copago AS valor, row_number() OVER (PARTITION BY account ORDER BY copago DESC, line_id DESC) AS r FROM lines WHERE bonif = 0 AND copago > 0), t AS (SELECT account, line_id, valor FROM r WHERE r = 1),
  f AS (SELECT account, valor, pos, total, row_number() OVER (PARTITION BY account ORDER BY total DESC, pos) AS k FROM t JOIN items USING (account) WHERE total BETWEEN 1 AND valor AND regexp_matches(upper(description), '{any_of(lx.NUTRITION)}')),
  w AS (SELECT account, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS sum, CAST([] AS BIGINT[]) AS picks FROM t UNION ALL SELECT w.account, f.k, w.sum + f.total, list_append(picks, f.k) FROM w JOIN f ON f.account = w.account AND f.k > w.k AND w.sum + f.total <= f.valor),
  h AS (SELECT w.account, min(picks) AS picks FROM w JOIN t ON t.account = w.account AND w.sum = t.valor GROUP BY ALL), m AS (SELECT h.account, f.pos, f.total FROM h JOIN f ON f.account = h.account AND list_contains(picks, f.k))
  SELECT t.account, line_id, valor, pos, total, pos IS NOT NULL AS matched FROM t LEFT JOIN m ON m.account = t.account""")
def j31b(spark, sf):
    return D.nutrition_match(_food_lines(spark, sf), star.bill_items(spark, sf))
