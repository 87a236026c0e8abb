"""Row-local predicates and rule classifiers over bill items, settlement lines and findings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.rules import Rule, all_matches, first_match, flags, let, lookup, score, search
from saldo.functions.text import contains_any, normalize_strict, normalize_upper, normalize_spaced


# -- bill items ---------------------------------------------------------------

def item_classes(description: Column, section: Column) -> dict[str, Column]:
    """Keyword classes of an item."""
    d, s = normalize_strict(description), normalize_strict(section)
    return {
        "amenity": contains_any(d, lx.AMENITY),
        "clinical_act": contains_any(d, lx.CLINICAL_ACT) & ~contains_any(d, lx.NON_CLINICAL),
        "admin": contains_any(d, lx.ADMIN),
        "eligible_strong": contains_any(d, lx.ELIGIBLE_STRONG),
        "eligible_weak": d.rlike(lx.ELIGIBLE_WEAK_PATTERN),
        "belongs": contains_any(s, lx.BELONGING_SECTION),
        "surgical_drug": contains_any(d, lx.SURGICAL_DRUG),
    }


def is_drug(section: Column, description: Column) -> Column:
    """Domain filter of drug lines: exclusions, then section, dosage in the operating room, form, name, dosage."""

    def test(t: Column) -> Column:
        s, d = t["s"], t["d"]
        dosed = s.contains("pabellon") & (d.contains("mg") | d.contains("ml") | d.contains("inyect"))
        included = (contains_any(s, lx.DRUG_SECTION) | dosed | contains_any(d, lx.DRUG_FORM) | contains_any(d, lx.DRUG_NAME)
                    | d.rlike(lx.DOSAGE_PATTERN))
        return ~contains_any(d, lx.DRUG_EXCLUDED) & included

    return let(F.struct(normalize_strict(section).alias("s"), normalize_strict(description).alias("d")), test)


def is_supply(section: Column, description: Column) -> Column:
    """Domain filter of supply lines: drugs and comfort items out, then section or item words."""

    def test(t: Column) -> Column:
        s, d = t["s"], t["d"]
        out = contains_any(d, lx.SUPPLY_EXCLUDED) | contains_any(d, lx.SUPPLY_COMFORT)
        sleeve = d.contains("manga") & d.contains("laparosc")
        return ~out & (sleeve | contains_any(s, lx.SUPPLY_SECTION) | contains_any(d, lx.SUPPLY_NAME))

    return let(F.struct(normalize_strict(section).alias("s"), normalize_strict(description).alias("d")), test)


def line_domain(code: Column, description: Column) -> Column:
    """Which domain filter a settlement line uses: CATCH_ALL, DRUG, SUPPLY or none."""
    return let(normalize_strict(description), lambda d: first_match(
        [("CATCH_ALL", code.startswith("320")), ("DRUG", (code == "3101001") | d.contains("medicamento")),
         ("SUPPLY", (code == "3101002") | d.contains("material"))], None))


def virtual_section(section: Column, description: Column) -> Column:
    """Section of an item, inferred from the description when blank."""
    return let(F.struct(normalize_strict(section).alias("s"), normalize_strict(description).alias("d")), lambda t: first_match(
        [(t["s"], (t["s"] != "") & (t["s"] != "sin seccion"))] + [(name, contains_any(t["d"], words)) for name, words in lx.VIRTUAL_SECTION], "OTROS"))


def billing_model(qty: Column, unit_price: Column, total: Column, granted: Column | None = None) -> Column:
    """struct(model, total, trust, proration, shift): does quantity times price explain the total?"""
    auth = total if granted is None else F.when(granted > 0, granted).otherwise(total)
    q, u, a = qty.cast("double"), unit_price.cast("double"), auth.cast("double")
    implied = a / q
    shifted = (q > 0) & (u > 0) & (a > 0) & (F.abs(implied - u) / F.greatest(implied, u) > lx.UNIT_PRICE_RATIO)
    exact = (F.abs(a - q * u) <= F.greatest(F.lit(2.0), a * 0.002)) & (u < lx.UNIT_PRICE_LIMIT)
    listed = F.exists(F.array(*[F.lit(float(v)) for v in lx.PRORATION]), lambda v: F.abs(q - v) < lx.PRORATION_TOLERANCE)
    prorated = (q < 2) & (listed | ((q < 0.99) & (q > 0)))
    case = first_match([("shift", shifted), ("exact", exact), ("prorated", prorated)], "review")
    return F.struct(
        lookup(case, {"shift": "UNIT_PRICE_UNTRUSTED", "prorated": "PRORATED_REFERENCE_PRICE"}, "MULTIPLICATIVE_EXACT").alias("model"),
        auth.alias("authoritative_total"),
        lookup(case, {"shift": 0.0, "exact": 1.0, "prorated": 0.5}, 0.8).alias("trust"),
        (case == "prorated").alias("proration"), (case == "shift").alias("column_shift"))


def taxonomy(section: Column, description: Column) -> Column:
    """struct(zone, family, subfamily)."""
    d, s = F.upper(description), F.upper(F.coalesce(section, F.lit("")))
    zone = first_match([(n, s.rlike(p)) for n, p in lx.ZONES], "OTROS")
    family = first_match([(n, d.rlike(p)) for n, p in lx.FAMILIES], "INSUMOS_MATERIALES")
    supply = first_match([(n, d.rlike(p)) for n, p in lx.SUPPLY_SUBFAMILIES], "OTROS")
    sub = first_match([("C3.1 - MEDICAMENTOS PABELLON", (family == "MEDICAMENTOS") & (zone == "PABELLON")),
                       ("C3.2 - MEDICAMENTOS HOSPITALIZACION", family == "MEDICAMENTOS"),
                       (supply, family == "INSUMOS_MATERIALES")], "OTROS")
    return F.struct(zone.alias("zone"), family.alias("family"), sub.alias("subfamily"))


def taxonomy_consistent(family: Column, description: Column) -> Column:
    """No drug described as a supply and no supply described as a drug."""
    d = F.upper(description)
    return ~(((family == "MEDICAMENTOS") & d.rlike(lx.SUPPLY_WORDS)) | ((family == "INSUMOS_MATERIALES") & d.rlike(lx.DRUG_WORDS)))


def etiology(description: Column, section: Column, has_surgery: Column, has_bed: Column) -> Column:
    """struct(type, absorbed_by, confidence): accessory act, standard supply, hotel item, misplaced surgical item or correct."""
    p = {k: search(description, v) for k, v in lx.ETIOLOGY.items()}
    nature = first_match([("ANESTESIA", p["anesthesia"]), ("MATERIAL_QUIRURGICO", p["surgical"]), ("HOTELERIA", p["bed_hotel"]),
                          ("INSUMO_SALA", p["ward_supply"]), ("MEDICAMENTO_GENERAL", p["drug"])], None)
    absorbed = first_match([("PABELLON", has_surgery & nature.isin("ANESTESIA", "MATERIAL_QUIRURGICO")),
                            ("DIA_CAMA", has_bed & nature.isin("HOTELERIA", "INSUMO_SALA"))], None)
    outside = ~search(section, "pabell")

    def r(kind: str | None, by: Column | str | None, conf: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), (by if isinstance(by, Column) else F.lit(by)).alias("absorbed_by"),
                        F.lit(conf).alias("confidence"))

    none = F.lit(None).cast("string")
    return first_match(
        [(r("M1_FRAUDE_TECNICO", F.when(has_bed, "DIA_CAMA").otherwise("ATENCION_HOSPITALARIA"), 0.95), p["accessory"]),
         (r("M3_ABSORCION_NORMATIVA", F.lit("NO_APLICA"), 0.99), p["hotel"]),
         (r("M2_UNBUNDLING_CLINICO", F.when(has_surgery, "PABELLON").otherwise("DIA_CAMA"), 0.90),
          p["standard_supply"] & (has_surgery | has_bed)),
         (r("CORRECTO", none, 0.7), p["schedule_code"]),
         (r("M2_UNBUNDLING_CLINICO", F.lit("PABELLON"), 0.8), (absorbed == "PABELLON") & outside),
         (r("CORRECTO", absorbed, 0.6), absorbed.isNotNull())],
        r(None, none, 0.0))


def item_rules(family: Column, zone: Column, description: Column, has_bed: Column, has_surgery: Column) -> Column:
    """Array of the item rules that fire: inherent to the bed-day, inherent to the operating room, not clinical."""
    d = normalize_strict(description)
    return all_matches([
        Rule("R-HOT-01", has_bed & contains_any(d, lx.AMENITY) & (family != "ESTADA_CAMA"), "HIGH", "DUPLICIDAD_HOTELERA"),
        Rule("R-PAB-01", has_surgery & contains_any(d, lx.ELIGIBLE_STRONG) & (zone != "PABELLON"), "HIGH", "DUPLICIDAD_PABELLON"),
        Rule("R-ADM-01", contains_any(d, lx.ADMIN), "WARN", "CARGO_NO_CLINICO"),
    ])


def cost_class(description: Column, section: Column) -> Column:
    """I, II, III, IV or null."""
    d = F.upper(description)
    return first_match([(n, d.rlike(p)) for n, p in lx.COST_CLASSES] + [("III", search(section, lx.COST_CLASS_SECTION))], None)


def material_bucket(description: Column) -> Column:
    return first_match([(n, search(description, p)) for n, p in lx.MATERIAL_BUCKETS], lx.MATERIAL_OTHER)


def hotel_bucket(description: Column, section: Column) -> Column:
    rules = [(n, search(description, p)) for n, p in lx.HOTEL_BUCKETS]
    rules[0] = (rules[0][0], rules[0][1] | search(section, "ALIMENTACION"))
    return first_match(rules, lx.HOTEL_OTHER)


# -- settlement lines ---------------------------------------------------------

def settlement_group(description: Column) -> Column:
    return let(normalize_upper(description), lambda d: first_match([(g, contains_any(d, words)) for g, words in lx.SETTLEMENT_GROUPS], "OTROS"))


def contract_domain(code: Column, description: Column) -> Column:
    """Exact code, then code ranges, then words."""
    exact = [(v, code == k) for k, v in lx.CODE_DOMAIN.items()]

    def ranges(d: Column) -> list[tuple[str, Column]]:
        return [("CONSULTA", code.startswith("01")), ("EXAMENES", code.rlike("^0[234789]")),
              ("KINESIOLOGIA", code.rlike("^0[56]")),
              ("PABELLON", code.rlike("^1[12]") & d.rlike("quirofano|pabellon|recuperac|anestesia")),
              ("HOSPITALIZACION", code.rlike("^1[12]")), ("HONORARIOS", code.rlike("^(1[3-9]|20)")),
              ("MEDICAMENTOS_HOSP", code.startswith("21")), ("MATERIALES_CLINICOS", code.startswith("31")),
              ("OTROS", code.startswith("32"))]

    return let(normalize_strict(description), lambda d: first_match(exact + ranges(d) + [(n, contains_any(d, w)) for n, w in lx.KEYWORD_DOMAIN], "OTROS"))


def gloss_type(code: Column, description: Column, valor: Column, copago: Column) -> Column:
    """TGE_A: everything rebounded under a generic text; TGE_B: denied by the fee schedule; NONE."""
    share = F.when(valor > 0, copago / valor).otherwise(F.lit(0.0))
    return let(normalize_strict(description), lambda d: first_match(
        [("TGE_A", (share > 0.95) & (d.contains("no cubierto") | d.contains("gastos") | code.startswith("320"))),
         ("TGE_B", d.contains("no contemplad") | d.contains("no arancel"))], "NONE"))


def line_warnings(valor: Column, bonif: Column, copago: Column) -> Column:
    """Array of input warnings of one line."""
    usable = (valor > 0) & (bonif >= 0) & (copago >= 0)
    return flags({"COPAGO_INVALID": copago.isNull() | (copago < 0),
                  "INCOHERENT": usable & (F.abs(bonif + copago - valor) > valor * 0.02 + 50)})


def is_zero_line(valor: Column, bonif: Column, copago: Column) -> Column:
    return (valor == 0) & (bonif == 0) & (copago == 0)


def line_priority(code: Column) -> Column:
    """Drugs, supplies, other not-covered, the rest, catch-all last."""
    return lookup(code, {"3101001": 1, "3101002": 2, "3201002": 3, "3201001": 9}, 5)


def repair_code(code: Column, description: Column) -> Column:
    """Seven digits from the description where the code is missing."""
    found = F.regexp_extract(description, r"\b(\d{7})\b", 1)
    usable = F.when(F.trim(code).isin("", "0", "SIN-CODIGO"), None).otherwise(F.trim(code))
    return F.coalesce(usable, F.nullif(found, F.lit("")))


def opacity_score(code: Column, description: Column, bonif: Column, copago: Column, trace_level: Column) -> Column:
    """struct(score, applies, parts)."""

    def scored(d: Column) -> Column:
        suspect = code.isin(lx.GROUP_CODES) | d.contains("no cubierto")
        parts = {
            ("GROUP_WITHOUT_BREAKDOWN", 25): suspect & trace_level.isin("TRACE_NONE", "TRACE_WEAK"),
            ("GENERIC_GLOSS", 20): d.contains("no cubierto") | d.contains("insumos") | d.contains("gasto"),
            ("NO_BONIFICATION", 15): (bonif == 0) & (copago > 0),
            ("NO_TRACE", 15): trace_level == "TRACE_NONE",
        }
        paid = (copago == 0) & (bonif > 0)
        total = F.when(paid, 0).otherwise(score([(k[1], p) for k, p in parts.items()]))
        names = F.array_compact(F.array(*[F.when(p & ~paid, F.lit(k[0])) for k, p in parts.items()]))
        return F.struct(total.alias("score"), (total >= lx.OPACITY_THRESHOLD).alias("applies"), names.alias("parts"))

    return let(normalize_strict(description), scored)


def noise_kinds(text: Column) -> Column:
    """Kinds of non-item lines a printed row belongs to."""

    def kinds(t: Column) -> Column:
        letters = t.rlike("[A-Z]")
        return flags({
            "SUMMARY": t.rlike("SUBTOTAL|TOTAL") | ~letters,
            "ADMINISTRATIVE": t.rlike(r"INFORME DE CUENTAS|PAGINA|HORA IMPRESION|PLAN:|FACTOR/CONV|FECHA EMISION|FOLIO P\.?A\.?M|COTIZANTE|"
                                      r"BENEFICIARIO|PRESTADOR|SOCIEDAD|BONO DEBE SER COBRADO|NOMBRE (PLAN|PRODUCTO|PACIENTE)|FECHA (DE LIQUIDACION|INGRESO)|"
                                      r"EMPRESA RUT|RUT |PREVISION|SUCURSAL|CUENTA |CODIGO DESCRIPCION FECHA|DETALLE|^CTA\d+_\d+_"),
            "SETTLEMENT": t.rlike(r"PROGRAMA DE ATENCION MEDICA|DEPARTAMENTOS? DE BENEFICIOS|DOCUMENTOS VALORIZADOS|FOLIO P\.?A\.?M|"
                                  r"BONO DEBE SER COBRADO|COTIZANTE|BENEFICIARIO|PRESTADOR|SOCIEDAD|NOMBRE (PLAN|PRODUCTO)|LIBRE ELECCION|P\.A\.M"),
            "RESIDUE": t.rlike("PRESTACION NO CONTEMPLADA EN EL ARANCEL|CARECE DE CODIGO EN EL ARANCEL|ARANCEL FONASA|NO TIENE COBERTURA|"
                               "DOCUMENTOS VALORIZADOS|HORA IMPRESION|DOCUMENTO VALIDO POR"),
            "CODE_ONLY": t.rlike(r"^\d{7,}(-[A-Z0-9])?$"),
        })

    return let(normalize_upper(text), kinds)


# -- findings -----------------------------------------------------------------

def finding_category(label: Column, rationale: Column) -> Column:
    """A or B of a finding without a category, from its wording."""
    g, t = F.upper(label), F.upper(rationale)
    drug = g.rlike("MEDICAMENTO|INSUMO|MATERIAL|FARMACO")
    return first_match([
        ("A", t.rlike("UNBUNDLING|EVENTO|FRAGMENTA|DUPLICI|DOBLE COBRO") | g.rlike("UNBUNDLING|EVENTO")),
        ("A", (g.rlike("ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION") | t.contains("IF-319")) & t.rlike("DUPLICI|DOBLE|INCLU")),
        ("B", drug & (t.rlike(r"SIN BONIFI|COBERTURA 0|BONIFICACION \$0|NO CUBIERTO") | g.contains("SIN BONIFI"))),
        ("A", t.rlike("SIGNOS VITALES|CURACION|INSTALACION VIA|FLEBOCLISIS|ENFERMERIA|TOMA DE MUESTRA") | g.contains("ENFERMERIA")),
        ("A", t.rlike("PROPOFOL|FENTANILO|SEVOFLURANO|MIDAZOLAM|ANESTESIA|ROCURONIO|VECURONIO") & t.rlike("PABELLON|QUIROFANO|FARMACIA PABELLON")),
        ("A", g.rlike("VARIOS|AJUSTE|DIFERENCIA|ESTADO DE CUENTA OPACO") | t.rlike("VARIOS|AJUSTE|BORROSO|SIN DESGLOSE")),
        ("A", t.rlike("UPCODING|INFLA|PRECIO EXCESIVO|DOSIS COMPLETA")),
        ("A", t.rlike("EVENTO UNICO|URGENCIA.*INTEGRADO|URGENCIA.*HOSPITALIZACION")),
        ("B", drug & t.rlike("DESGLOSE|OPACIDAD|CAJA")),
    ], "B")


def is_protected(label: Column, rationale: Column, amount: Column, code: Column, surgical: Column, stay: Column) -> Column:
    """Finding that must stay improper: not-covered hypotheses A-E or a normative family; surgical and stay are event facts."""
    g, t = F.upper(label), F.upper(rationale)
    uncovered = g.rlike("GASTOS? NO CUBIERTO|PRESTACION NO CONTEMPLADA|VARIOS|AJUSTES|3201001|3201002") & (amount > 0)
    full = t.rlike("(COBERTURA|BONIFICACION).*(100%|TOTAL|COMPLETA)")
    supplies = g.rlike("MATERIAL|INSUMO|OXIGENO|PUNCION|SUTURA|GASAS|JERINGA|ANTISEPTICO") | t.rlike("MATERIAL|INSUMO|OXIGENO|PABELLON")
    hypotheses = uncovered & (
        surgical | (stay & t.rlike("ASEO|CONFORT|KITS?|ROPA|PIJAMA|TERMOMETRO|MUESTRA"))
        | t.rlike("EPP|SEGURIDAD|INFRAESTRUCTURA|COSTO OPERACIONAL|INSUMO INSTITUCIONAL") | full
        | (supplies & t.rlike("PLAN PLENO|COBERTURA 100%|TOTAL")))
    normative = (
        g.rlike("UNBUNDLING|EVENTO UNICO|FRAGMENTA|DUPLICI|DOBLE COBRO") | t.rlike("UNBUNDLING|EVENTO")
        | g.rlike("ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION|ASEO PERSONAL|SET DE ASEO") | t.rlike("IF-?319")
        | g.rlike("SIGNOS VITALES|CURACION|INSTALACION VIA|FLEBOCLISIS|ENFERMERIA|TOMA DE MUESTRA") | t.contains("ENFERMERIA")
        | g.rlike("URGENCIA.*HOSPITALIZACION") | t.contains("ALERTA_EU_01")
        | g.rlike("BONIFICACION INCORRECTA|INCUMPLIMIENTO CONTRACTUAL|DIFERENCIA COBERTURA|RECLASIFICACION ESTRATEGICA") | full)
    opaque = g.rlike("OPACO|INDETERMINADO|SIN DESGLOSE|FALTA DE TRAZABILIDAD") | t.rlike("OPACO|INDETERMINADO|SIN DESGLOSE")
    last = F.coalesce(code.isin(lx.PROTECTED_CODES), F.lit(False)) | g.contains("FRAUDE TECNICO") | t.contains("ACTO NO AUTONOMO")
    return hypotheses | normative | (~opaque & last)


def is_opaque(label: Column, rationale: Column, category: Column, resolved: Column) -> Column:
    """Finding that only says the settlement cannot be read."""
    g, t = F.upper(label), F.upper(rationale)
    excluded = (resolved | t.contains("[RESUELTO_CODIGO]") | t.rlike("NO MAPEA|FALTA DICCIONARIO|FALTA TABLA|NEEDS_MAPPING")
                | t.rlike("(COBERTURA|BONIFICACION).*(100%|TOTAL|COMPLETA)")
                | g.rlike("INCUMPLIMIENTO CONTRACTUAL|UNBUNDLING|EVENTO UNICO|RECLASIFICACION"))
    signals = ((category == "Z") | g.rlike("OPACIDAD|INDETERMINADO|BORROSO|SIN DESGLOSE|CARGA DE LA PRUEBA|LEY 20.?584")
               | g.rlike("PRESTACION NO CONTEMPLADA|GASTOS? NO CUBIERTO|VARIOS|AJUSTE|DIFERENCIA")
               | t.rlike("OPACIDAD|INDETERMINADO|BORROSO|SIN DESGLOSE|RECOLECCION"))
    return ~excluded & signals


def needs_unit(label: Column, rationale: Column) -> Column:
    t = F.concat(F.upper(label), F.upper(rationale))
    return t.rlike("TOPE|TECHO|UF|VAM|AC2|PRORRATEO|VALORIZACION") & ~t.rlike("UNBUNDLING|FRAGMENTACION|FRAGMENTADO|INCOMPATIBILIDAD")


def unit_verifiable(state: Column, confidence: Column, finding_type: Column) -> Column:
    return (state == "VERIFICABLE") & (confidence >= lookup(finding_type, lx.VERIFIABILITY, lx.VERIFIABILITY_DEFAULT))


def can_promote(repeats: Column, several_events: Column, clause: Column, precedent: Column) -> Column:
    """Disputed to improper: twice in one event needs a precedent, over several events a clause or a precedent."""
    return (repeats >= 2) & F.when(several_events, clause | precedent).otherwise(precedent)


def categorize(f: dict[str, Column]) -> Column:
    """struct(category, action) by an ordered chain. Keys: label, rationale, category, amount, resolved, protected, opaque,
    unit_ok, validated, repeats, several_events."""
    t = F.upper(f["rationale"])
    g = F.upper(f["label"])
    vague = t.rlike("INDETERMINACION|NO PERMITE CLASIFICAR|NO SE PUEDE VERIFICAR|LEY 20.?584")
    clause, precedent = t.rlike("INCUMPLIMIENTO|DERECHO|DOCTRINA"), t.rlike("PRECEDENTE|CORRECCIÓN|JURISPRUDENCIA")
    drug = "MEDICAMENTO|MATERIAL|INSUMO|FARMACO"
    positive = f["amount"] > 0
    out = first_match([
        ("OK|ACEPTAR", f["resolved"]),
        ("OK|", (f["category"] == "OK") & t.rlike(r"\[MEJORA\]|\[PRAGMATISMO\]")),
        ("Z|SOLICITAR_ACLARACION", needs_unit(f["label"], f["rationale"]) & ~f["unit_ok"]),
        ("A|IMPUGNAR", positive & ((f["category"] == "A") | f["protected"])),
        ("A|IMPUGNAR", positive & (f["category"] == "B") & can_promote(f["repeats"], f["several_events"], clause, precedent)),
        ("OK|ACEPTAR", (f["opaque"] | vague) & f["validated"]),
        ("Z|SOLICITAR_ACLARACION", vague),
        ("Z|SOLICITAR_ACLARACION", f["opaque"] | ((g.rlike(drug) | t.rlike(drug)) & ~f["protected"])),
        ("B|SOLICITAR_ACLARACION", t.rlike("NO MAPEA|FALTA DICCIONARIO|FALTA TABLA|NEEDS_MAPPING")),
        ("OK|ACEPTAR", ~positive),
    ], F.concat(F.coalesce(f["category"], F.lit("B")), F.lit("|")))
    pair = F.split(out, r"\|")
    return F.struct(pair.getItem(0).alias("category"), pair.getItem(1).alias("action"))


def finding_state(has_a: Column, has_z: Column, has_b: Column) -> Column:
    """struct(state, action): improper, then indeterminate, then disputed."""
    case = first_match([("A", has_a), ("Z", has_z), ("B", has_b)], "OK")
    return F.struct(
        lookup(case, {"A": "IMPROCEDENTE", "Z": "INDETERMINADO", "B": "EN_CONTROVERSIA"}, "VALIDABLE").alias("state"),
        lookup(case, {"A": "IMPUGNAR / EXTORNO", "Z": "SOLICITAR ACLARACION", "B": "SOLICITAR DESGLOSE / RELIQUIDACION"}, "OK").alias("action"))


def evidence_needed(text: Column) -> Column:
    t = normalize_upper(text)
    return first_match([("RELIQUIDACION_CON_DESGLOSE", t.rlike("OPACIDAD|SIN DESGLOSE|CAJA NEGRA")),
                        ("ACLARACION_DESTINATARIO", t.rlike("HOTELERIA|ALIMENTACION|UNBUNDLING"))], "ANTECEDENTES_DE_RESPALDO")


def account_state(a: Column, b: Column, z: Column) -> Column:
    return first_match([("COPAGO_MIXTO_CONFIRMADO_Y_OPACO", (a > 0) & ((z > 0) | (b > 0))), ("COPAGO_OBJETABLE_CONFIRMADO", a > 0),
                        ("COPAGO_INDETERMINADO_POR_OPACIDAD", z > 0), ("COPAGO_BAJO_CONTROVERSIA", b > 0)], "COPAGO_OK_CONFIRMADO")


def account_decision(a: Column, b: Column, z: Column, ok: Column, total: Column) -> Column:
    """The second rule set: a proven breach decides alone."""
    return first_match([("CUENTA_IMPUGNABLE_POR_INCUMPLIMIENTO_CONTRACTUAL", a > 0), ("OPACIDAD ESTRUCTURAL (COPAGO INDETERMINADO)", z > 0),
                        ("CONTROVERSIA POR FALTA DE DESGLOSE", b > 0), ("CORRECTO (VALIDADO)", (ok == total) & (total > 0)),
                        ("SIN COPAGO INFORMADO", total == 0)], "AUDITABLE")


def protect_state(state: Column, frozen_a: Column) -> Column:
    """An indeterminate account that holds a frozen improper decision is mixed."""
    return F.when((state == "COPAGO_INDETERMINADO_POR_OPACIDAD") & frozen_a, "COPAGO_MIXTO_CONFIRMADO_Y_OPACO").otherwise(state)


def line_features(code: Column, description: Column, bonif: Column, copago: Column, full_cover: Column, explicit: Column) -> Column:
    """Feature set of a settlement line for precedents and doctrine."""

    def facts(d: Column) -> Column:
        kind = first_match([("MED", d.rlike("MEDIC|FARMAC|DROGA")), ("MAT", d.contains("MATER")), ("INS", d.contains("INSUM")),
                            ("VAR", d.rlike("VARIOS|OTROS|MISCELAN"))], "OTRO")
        relabeled = d.rlike("NO CUBIERTO|PRESTACION NO CONTEMPLADA|SIN BONIF|SIN COBERTURA|EXCLUIDO") & d.rlike(
            "HONORARIO|PABELLON|ANESTESIA|MEDICAMENTO|INSUMO|MATERIAL CLINICO")
        return F.struct(
            kind.alias("kind"), relabeled.alias("relabeled"), d.rlike("MATERIAL|MEDICAMENTO|INSUMO|VARIOS|PRESTACIONES SIN BONIF").alias("generic"),
            d.rlike("SIGNOS VITALES|CURACION|INSTALACION VIA|FLEBOCLISIS|ENFERMERIA|TOMA DE MUESTRA|PROPOFOL|FENTANILO|SEVOFLURANO|"
                    "MIDAZOLAM|ANESTESIA").alias("included"),
            d.rlike("ALIMENTA|NUTRICI|HOTEL|CAMA|PENSION|CONFORT|KIT DE ASEO|PANTUFLAS|ROPA|MANTENCION|ESTACIONAMIENTO|TELEVISION|WIFI").alias("hotel"),
            d.rlike("EXAMEN|LABORATORIO|RADIOLOG|BIOPSIA|HEMOGRAMA|CULTIVO|PERFIL|ORINA|SANGRE").alias("exam"))

    def names(t: Column) -> Column:
        kind, generic, included, hotel = t["kind"], t["generic"], t["included"], t["hotel"]
        breach = (full_cover | (kind.isin("MED", "MAT", "INS") & explicit) | t["relabeled"]) & (copago > 0)
        opaque_line = generic & (copago > 0)
        return flags({
            "BONIF_0": bonif == 0, "COPAGO_POS": copago > 0, "GENERIC_PAM_LINE": generic, "INHERENTLY_INCLUDED": included,
            "ES_HOTELERIA": hotel, "ES_EXAMEN": code.startswith("03") | t["exam"], "STRATEGIC_RECLASSIFICATION": t["relabeled"],
            "MED_OR_INS": kind.isin("MED", "INS"), "COV_EXPLICIT": explicit, "COV_100": full_cover, "IC_BREACH": breach,
            "UB_DETECTED": included, "HT_DETECTED": hotel, "OPACIDAD_LINEA": opaque_line,
            "OP_DETECTED": opaque_line & ~breach & ~included & ~hotel,
        })

    return let(let(normalize_spaced(description), facts), names)


# -- contracts ----------------------------------------------------------------

# Words of the canonical categories, in order.
CANONICAL_CATEGORIES = [
    ("HOSPITALARIO", ["dia cama", "hospitalizacion", "pabellon", "derecho sala", "insumos hospitalarios"]),
    ("AMBULATORIO", ["consulta", "visita", "laboratorio", "examen", "radiologia", "densitometria", "doppler", "ecografia",
                     "ecotomografia", "procedimientos", "imagenologia", "scanner", "tac", "resonancia", "mamografia", "rayos x",
                     "radiografia", "biopsia", "colonoscopia", "endoscopia", "kinesiologia", "fonoaudiologia", "terapias", "dialisis",
                     "nutricionista", "psicometria", "telemedicina"]),
    ("MATERNIDAD", ["parto", "cesarea", "neonatologia", "aborto", "embarazo", "obstetrica"]),
    ("ONCOLOGIA", ["quimioterapia", "radioterapia", "citotoxicas", "oncologi"]),
    ("SALUD_MENTAL", ["psicologia", "psiquiatria", "salud mental"]),
    ("DENTAL", ["dental", "odontologi"]),
    ("AMBULATORIO", ["optica", "anteojos", "lentes", "audifonos", "marcapaso", "protesis", "ortesis"]),
    ("EXCLUSION", ["exclusiones", "no cubre"]),
    ("LEGAL", ["ley", "articulo", "dfl"]),
    ("FINANCIERO", ["uf", "reajuste", "ipc", "unidad de fomento"]),
    ("GES", ["ges", "explicit"]),
    ("CAEC", ["caec", "catastrof"]),
    ("FACTORES", ["factores", "riesgo"]),
    ("HOSPITALARIO", ["hosp"]),
    ("AMBULATORIO", ["amb"]),
    ("URGENCIA", ["urg"]),
]


def canonical_category(text: Column) -> Column:
    from saldo.functions.text import fold

    return let(fold(F.lower(text)), lambda t: first_match([(n, contains_any(t, words)) for n, words in CANONICAL_CATEGORIES], "OTRO"))


def benefit_section(benefit_class: Column) -> Column:
    a = F.upper(benefit_class)
    return first_match([
        ("HOSPITALARIAS_Y_CIRUGIA_MAYOR_AMBULATORIA",
         a.isin("DIA_CAMA", "PABELLON", "HONORARIOS", "MEDICAMENTOS", "MATERIALES", "PROTESIS", "EXAMENES")),
        ("AMBULATORIAS", a == "AMBULATORIO"), ("ATENCIONES_DE_URGENCIA", a == "URGENCIA")], "OTRAS_PRESTACIONES")


def section_domain(title: Column) -> Column:
    t = F.upper(title)
    return first_match([("HOSPITALIZACION", t.contains("HOSPITALARIA")), ("AMBULATORIO", t.contains("AMBULATORIA")),
                        ("URGENCIA", t.contains("URGENCIA")), ("HONORARIOS", t.contains("HONORARIO")),
                        ("OBSTETRICIA_NEONATOLOGIA", t.rlike("OBSTETRICA|NEONATOLOGIA")), ("RESTRINGIDA", t.contains("RESTRINGIDA")),
                        ("OTROS", t.contains("OTRAS PRESTACIONES"))], None)


def page_type(text: Column) -> Column:
    """Coverage grid, factor table, code catalog, definitions, or unknown, from counts of signals in normalized text."""
    percents = F.regexp_count(text, F.lit("%"))
    codes = F.regexp_count(text, F.lit(r"\b\d{7}\b"))
    meta = F.regexp_count(text, F.lit("tipo de plan|tabla de factores|cotizacion legal|cotizantes|cargas|tramos de edad|precio base"))
    core = F.regexp_count(text, F.lit("hospital|dia cama|pabell|honorar|medicament|material|insumo|urgenc"))
    units = text.rlike(r"\buf\b|\bv\.?a\.?\b|\bvam\b|sin\s+tope|copago")
    modal = text.rlike(r"preferente|libre\s*elecci|bonificaci|tope|copago")
    return first_match([
        ("WAIT_TIMES_TABLE", text.rlike("tiempo maximo|garantia explicita")),
        ("FACTOR_TABLE", ((meta >= 5) & (percents <= 2)) | ((meta >= 2) & (core == 0) & (percents == 0))),
        ("ARANCEL_CATALOG", (codes > 5) & (percents == 0)),
        ("DEFINITIONS_TEXT", text.rlike("definicion|glosario|condiciones generales|articulo|circular|en virtud de") & (percents < 2) & (core == 0)),
        ("COVERAGE_GRID", ((core >= 1) & ((percents >= 1) | units)) | (modal & (percents >= 1))),
    ], "UNKNOWN")


def line_effect(text: Column) -> Column:
    t = F.lower(text)
    return first_match([("EXPANSIVO", t.contains("sin tope")),
                        ("LIMITANTE", t.rlike(r"tope|uf|ac2|veces|\b\d+([.,]\d+)?\s*x\b"))], "NEUTRO")


def line_scope(col: Column, text: Column) -> Column:
    t = F.lower(text)
    return first_match([
        ("PREFERENTE_RED", t.contains("solo") & t.contains("libre elecci")), ("TOPE_EVENTO", col.isin(2, 4, 5, 6)),
        ("TOPE_ANUAL_NFE", col == 7), ("PORCENTAJE", t.contains("%")), ("PREFERENTE_MODAL", t.rlike(r"a\.1|a\.2|institucional")),
        ("PREFERENTE_RED", t.rlike("clínica|red|uc|christus|davila|vespucio"))], "FINANCIAL_DOMAIN")


def line_operators(col: Column, text: Column) -> Column:
    """Array of the typed operators a contract cell carries."""
    t = F.lower(text)
    scope = line_scope(col, text)
    financial = t.rlike("medic|material|traslado|pr[oó]tesis|[oó]rtesis|osteos[ií]ntesis|quimioterapia")
    return flags({
        "HERENCIA_CORTADA": t.contains("solo") & t.contains("libre elecci"), "CAMBIO_DOMINIO_FINANCIERO": financial,
        "TOPE_EVENTO": scope == "TOPE_EVENTO",
        "TOPE_ANUAL_NFE": (scope == "TOPE_ANUAL_NFE") | (financial & t.contains("sin tope") & (scope != "TOPE_EVENTO")),
        "PORCENTAJE": scope == "PORCENTAJE"})


def is_modality_lock(text: Column) -> Column:
    return search(text, "(solo|exclusivo|[uú]nicamente).*libre\\s+elecc|no\\s+aplica.*oferta\\s+preferente|se\\s+bonifica\\s+solo\\s+en\\s+libre|"
                        "medicamentos hospitalarios|materiales cl[ií]nicos")


def contract_family(assignments: Column, status: Column) -> Column:
    return first_match([("B", assignments < 5), ("C", status == "WARN")], "A")


# Legacy column ids and their present names.
COLUMN_IDS = {"C1_PRESTACIONES": "COL_PRESTACIONES", "C2_PCT": "COL_PREF_PCT", "C2_PREF_PCT": "COL_PREF_PCT",
              "C3_TOPE_1": "COL_PREF_TOPE_EVENTO", "C3_PREF_TOPE": "COL_PREF_TOPE_EVENTO", "C4_TOPE_MAX_2": "COL_PREF_TOPE_ANUAL",
              "C4_PREF_ANNUAL": "COL_PREF_TOPE_ANUAL", "C5_TOPE_INT_3": "COL_LE_TOPE_EVENTO", "C5_LE_PCT": "COL_LE_PCT",
              "C6_AMPLIACION_4": "COL_AMPLIACION", "C6_LE_TOPE": "COL_LE_TOPE_EVENTO", "C7_LE_ANNUAL": "COL_LE_TOPE_ANUAL",
              "C4_LE_PCT": "COL_LE_PCT", "C5_LE_TOPE": "COL_LE_TOPE_EVENTO", "C6_ANNUAL_MAX": "COL_PREF_TOPE_ANUAL"}


def column_id(c: Column) -> Column:
    return first_match([("UNKNOWN_COL", c.isNull() | (c == "")), ("COL_PREF_PCT", c.contains("C2_C3") | c.rlike(r"C\d+\+C\d+")),
                        ("COL_LE_PCT", c.contains("C5_C6"))], lookup(c, COLUMN_IDS, c))


def row_id(c: Column) -> Column:
    return first_match([("UNKNOWN_ROW", c.isNull() | (c == "")), (F.concat(F.lit("R_"), c), ~c.startswith("R_") & c.rlike("[A-Z_]+"))], c)


def reconstructibility(has_rules: Column, contract_text: Column, account_text: Column) -> Column:
    """struct(score, reconstructible)."""
    c, a = F.upper(contract_text), F.upper(account_text)
    points = score([(50, has_rules), (30, c.rlike("100%|COBERTURA TOTAL|SIN TOPE|PAD")), (10, c.contains("TOPE") & c.rlike(r"\d+\s*UF")),
                    (10, a.rlike("APENDIC|COLECIST|HERNIA|PARTO|CESAREA"))])
    return F.struct(points.alias("score"), (points >= 50).alias("reconstructible"))


def penalty_score(critical: Column, major: Column, minor: Column) -> Column:
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), 10 - critical * 3.5 - major * 2.0 - minor * 0.8))


def motor(f: dict[str, Column]) -> Column:
    """struct(level, motor, gloss_type, impact) of a settlement line: the ordered decision over line, matched items and contract.

    Keys: code, description, valor, bonif, copago, trace_level, unique_amount, n_items, matched_sum, single_amenity,
    single_clinical_act, all_amenity, any_strong, any_weak, any_belongs, any_surgical_drug, amenity_share, admin_share,
    has_surgery, has_stay, check_state, check_pct, check_copago, check_excess, check_tolerance, alt_found, alt_pct, alt_copago.
    """

    def decide(d: Column) -> Column:
        code, copago, bonif, valor = f["code"], f["copago"], f["bonif"], f["valor"]
        not_covered = code.isin(lx.NOT_COVERED_CODES)
        generic = code.isin(lx.GROUP_CODES) | contains_any(d, lx.GENERIC_GLOSS)
        hard = f["trace_level"] == "TRACE_OK"
        delta = F.abs(f["matched_sum"] - valor)
        clinical = f["any_strong"] | (f["any_weak"] & f["any_belongs"]) | f["any_surgical_drug"]
        some = f["n_items"] > 0
        event = f["has_surgery"] | f["has_stay"]

        invented = (not_covered | d.contains("no contemplada en el arancel") | d.contains("no cubierto por el plan")) & (
            f["n_items"] == 1) & ~f["single_amenity"] & ((code != "3201001") | f["single_clinical_act"])
        nursing = contains_any(d, lx.NURSING_ACT) & ~d.contains("pabellon") & ~d.contains("dia cama")
        accessory = (bonif == 0) & (copago > 0) & ~code.isin("3101001", "3101002") & ~not_covered & ~generic
        rebound = (bonif == 0) & (F.abs(copago - valor) < 2)
        unbundled = rebound & code.isin(lx.UNBUNDLING_CODES) & some & (f["trace_level"] != "TRACE_NONE") & ~f["all_amenity"] & (
            (f["any_strong"] & event) | (f["any_surgical_drug"] & f["has_surgery"]) | (f["any_weak"] & f["any_belongs"] & event))
        shifted = rebound & (not_covered | d.rlike("no cubierto|insumos|gasto|otros|materiales|no gasto medico")) & some & ~clinical
        gloss = first_match([("TGE_C", f["amenity_share"] >= 0.6), ("TGE_D", f["admin_share"] >= 0.6), ("TGE_E", f["amenity_share"] >= 0.3)], "TGE_A")
        domain = contract_domain(code, f["description"])
        pct, alt = F.coalesce(f["check_pct"], F.lit(0.0)), F.coalesce(f["alt_pct"], F.lit(0.0))
        moved = event & domain.isin(lx.AMBULATORY_DOMAINS) & (copago > F.coalesce(f["check_tolerance"], F.lit(1000))) & f["alt_found"] & (
            (alt > pct) | ((f["check_state"] == "INFRA_BONIFICACION") & (alt >= pct)))
        gain = F.coalesce(f["check_copago"], copago) - F.coalesce(f["alt_copago"], F.lit(0))

        def r(level: str, m: str, impact: Column, g: Column | None = None) -> Column:
            return F.struct(F.lit(level).alias("level"), F.lit(m).alias("motor"),
                            (g if g is not None else F.lit("NONE")).alias("gloss_type"), impact.cast("double").alias("impact"))

        return first_match([
            (r("CORRECTO", "NA", F.lit(0)), copago == 0),
            (r("NO_ARANCELABLE", "M1", copago), invented),
            (r("NO_ARANCELABLE", "M1", copago), nursing),
            (r("NO_ARANCELABLE", "M1", copago), accessory),
            (r("FRAGMENTACION_ESTRUCTURAL", "M2", copago), unbundled),
            (r("FRAGMENTACION_ESTRUCTURAL", "M3", copago, gloss), shifted),
            (r("DISCUSION_TECNICA", "M4", F.least(copago, F.when(gain == 0, copago).otherwise(gain))), moved),
            (r("CORRECTO", "NA", F.lit(0)), hard & (delta < 2) & (f["check_state"] == "VERIFICABLE_OK")),
            (r("FRAGMENTACION_ESTRUCTURAL", "M3", copago), some & (generic | (delta < 100))),
            (r("INFRA_BONIFICACION", "M5", f["check_excess"]), (f["check_state"] == "INFRA_BONIFICACION") & (f["check_excess"] > 0)),
            (r("DISCUSION_TECNICA", "M5", copago), f["check_state"] == "TOPE_EXCEDIDO"),
        ], r("FRAGMENTACION_ESTRUCTURAL", "M4", copago))

    return let(normalize_strict(f["description"]), decide)
