"""Signals, flags, hypotheses and opacity declarations per account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.money import clamp01, total
from saldo.functions.rules import first_match, flags, search
from saldo.functions.text import contains_any


def account_anchors(items: DataFrame) -> DataFrame:
    """Sections of the account: operating room, bed, urgency."""
    s = F.col("section")
    return items.groupBy("account").agg(
        F.bool_or(search(s, "pabell")).alias("has_surgery"),
        F.bool_or(search(s, r"d[ií]as?\s*cama|hospitaliz")).alias("has_bed"),
        F.bool_or(search(s, "urgenc")).alias("has_urgency"))


# Patterns of the account signals.
GENERIC = r"GASTOS? NO CUBIERTO|PRESTACION NO CONTEMPLADA|NO CUBIERTO|RECHAZO|AJUSTE|VARIO|INSUMO VARIO"
GROUPED = r"agrup|consolid|generico|varios|total|clinicos|quirurgicos"
DAY_BED = r"DIA[\s_]*CAMA|HABITACION|SALA|PENSION"
HOTEL = r"toalla|sabana|frazada|almohada|tv cable|wifi|estacionamiento|agrup. pabellon"
FOOD = r"almuerzo|cena|desayuno|colacion|liquido|nutrici|alimenta"
HOTEL_SURE = r"toalla|sabana|tv cable|wifi|estacionamiento"
GENERIC_CODES = ["8002001", "9001001", "9201001", "201407", "9201003"]


def _grouping(d: Column, word: str) -> Column:
    """How grouped a category looks: 1 explicit, 0.9 few lines with much copago, 0.3 present, 0 absent."""
    has = F.upper(d).contains(word)
    hits = F.count_if(has)
    return first_match([(1.0, F.bool_or(has & search(d, GROUPED))), (0.9, (hits > 0) & (hits <= 2) & (total(F.when(has, F.col("copago"))) > 10000)), (0.3, hits > 0)], 0.0)


def _validated(d: Column, words: str) -> Column:
    has = F.upper(d).rlike(words)
    n = F.count_if(has)
    return first_match([(0.0, n == 0), (0.0, F.count_if(has & F.col("code").isin(GENERIC_CODES)) / n > 0.7)], 1.0)


def account_signals(lines: DataFrame, items: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row of signals per account. coverage: account, n_coverages, hospital_cover, ambulatory_cover."""
    d = F.col("description")
    pam = lines.groupBy("account").agg(
        _grouping(d, "MATERIALES").alias("grouped_materials"), _grouping(d, "MEDICAMENTOS").alias("grouped_drugs"),
        F.bool_or(search(d, GENERIC)).cast("double").alias("generic"), _validated(d, "HONORARIO|CIRUJANO|ANESTESISTA|MEDICO|VISITA|INTERCONSULTA").alias("val_fees"),
        _validated(d, "PABELLON").alias("val_surgery"))
    t = F.col("description")
    bill = items.groupBy("account").agg(
        F.bool_or(search(t, DAY_BED) | search(F.col("section"), DAY_BED)).cast("double").alias("day_bed"),
        F.least(F.lit(1.0), F.count_if(search(t, HOTEL)) / 3).alias("hotel"), F.least(F.lit(1.0), F.count_if(search(t, FOOD)) / 2).alias("food"))
    key = F.upper(F.trim(F.coalesce("code", "description")))
    top = items.filter(F.length(key) > 3).groupBy("account", key.alias("k")).agg(F.count(F.lit(1)).alias("n")).groupBy("account").agg(F.max("n").alias("n"))
    repeated = first_match([(1.0, F.col("n") > 20), (0.7, F.col("n") > 10), (0.3, F.col("n") > 5)], 0.0)
    j = coverage.join(bill, "account").join(top.select("account", repeated.alias("repetition")), "account", "left").join(pam, "account", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mismatch = (zero("day_bed") > 0) & ~F.col("hospital_cover") & F.col("ambulatory_cover")
    return j.select(
        "account", F.col("generic").isNotNull().cast("double").alias("pam"), *[zero(c).alias(c) for c in ("grouped_materials", "grouped_drugs", "generic", "day_bed", "hotel", "food")],
        (F.col("n_coverages") == 0).cast("double").alias("no_coverage"), mismatch.cast("double").alias("mismatch"), zero("repetition").alias("repetition"),
        zero("val_fees").alias("val_fees"), zero("val_surgery").alias("val_surgery"), (1 - zero("grouped_drugs")).alias("val_drugs"), (1 - zero("grouped_materials")).alias("val_materials"))


def settlement_state(s: dict[str, Column]) -> Column:
    index = s["generic"] * 0.40 + s["grouped_materials"] * 0.35 + s["grouped_drugs"] * 0.35
    return first_match([("ABSENT", s["pam"] <= 0.5), ("OPACO", index > 0.6)], "DETALLADO")


HYPOTHESES = ["OPACIDAD", "UNBUNDLING", "INCUMPLIMIENTO", "IRREGULAR", "FRAUDE", "TECNICO", "OK"]


def hypotheses(signals: DataFrame) -> DataFrame:
    """Confidence of every hypothesis after inhibition, and the settlement state."""
    s = {c: F.col(c) for c in signals.columns}
    j = signals.withColumn("state", settlement_state(s))
    c = F.col
    j = j.withColumns({
        "_op": clamp01(F.when(c("state") == "OPACO", c("generic") * 0.15 + 0.85).otherwise(0.2)),
        "_ub": clamp01(c("day_bed") * 0.4 + 0.2 + c("hotel") * 0.2 + c("food") * 0.2),
        "INCUMPLIMIENTO": clamp01(c("no_coverage") * 0.5 + 0.2 + c("mismatch") * 0.3),
        "IRREGULAR": clamp01(c("generic") * 0.5 + 0.15 + c("repetition") * 0.2 + c("hotel") * 0.15)})
    j = j.withColumns({
        "_fr": clamp01(c("IRREGULAR") * 0.45 + 0.05 + c("_ub") * 0.35 - c("_op") * 0.30), "TECNICO": clamp01(c("IRREGULAR") * 0.6 + 0.1 + c("hotel") * 0.3),
        "OK": clamp01(F.lit(0.9) - c("generic") * 0.35 - c("hotel") * 0.25 - c("no_coverage") * 0.25 - c("IRREGULAR") * 0.2)})
    dominant = c("_op") > 0.8
    return j.withColumns({"OPACIDAD": c("_op"), "FRAUDE": F.when(dominant, c("_fr") * 0.4).otherwise(c("_fr")),
                          "UNBUNDLING": F.when(dominant, c("_ub") * 0.5).otherwise(c("_ub"))}).select(*signals.columns, "state", *HYPOTHESES)


def ranked_hypotheses(scored: DataFrame) -> DataFrame:
    """Hypotheses of each account, most confident first; the fixed order breaks ties."""
    pairs = F.array(*[F.struct((-F.round(h, 9)).alias("s"), F.lit(i).alias("i"), F.lit(h).alias("hypothesis")) for i, h in enumerate(HYPOTHESES)])
    e = scored.select("account", F.posexplode(F.array_sort(pairs)).alias("n", "h"))
    return e.select("account", (F.col("n") + 1).alias("rank"), "h.hypothesis", (-F.col("h.s")).alias("confidence"))


def opaque_copago(lines: DataFrame) -> DataFrame:
    """Copago in grouped or generic lines and in all lines."""
    target = F.upper("description").rlike("MATERIALES|MEDICAMENTOS|INSUMOS|SUMINISTROS") | search(F.col("description"), "agrup|consolid|generico|varios|total")
    return lines.groupBy("account").agg(total(F.when(target, F.col("copago"))).alias("opaque"), F.sum("copago").alias("copago"))


def active_hypotheses(scored: DataFrame, copago: DataFrame) -> DataFrame:
    """Array of active hypotheses: thresholds, and opacity only when it holds 15 % of the copago or more."""
    j = scored.join(copago, "account")
    c = F.col
    big = (c("state") == "OPACO") & ~((c("copago") > 0) & (c("opaque") / c("copago") < 0.15))
    active = flags({"OPACIDAD": big, "UNBUNDLING": c("UNBUNDLING") > 0.6, "INCUMPLIMIENTO": c("INCUMPLIMIENTO") > 0.6, "IRREGULAR": c("IRREGULAR") > 0.65,
                    "FRAUDE": (c("FRAUDE") > 0.8) & (c("IRREGULAR") > 0.75) & (c("UNBUNDLING") > 0.65), "TECNICO": c("TECNICO") > 0.6})
    best = F.greatest(*[c(h) for h in HYPOTHESES[:-1]])
    return j.select("account", "state", "opaque", "copago", F.when((F.size(active) == 0) & (c("OK") >= best), F.array(F.lit("OK"))).otherwise(active).alias("active"), c("OPACIDAD").alias("opacity_confidence"))


def structural_findings(active: DataFrame, items: DataFrame) -> DataFrame:
    """Findings of the active hypotheses: opaque copago (B), hotel charges (A when unmistakable, else B without opacity)."""
    t = F.col("description")
    hot = search(t, f"{HOTEL}|{FOOD}")
    h = items.groupBy("account").agg(total(F.when(hot, F.col("copago"))).alias("hotel"), F.bool_or(hot & search(t, HOTEL_SURE)).alias("sure"))
    j = active.join(h, "account", "left")
    c = F.col
    has = lambda n: F.array_contains("active", n)
    f = lambda p, label, cat, amount: F.when(p, F.struct(F.lit(label).alias("label"), F.lit(cat).alias("category"), amount.alias("amount")))
    fs = F.array_compact(F.array(
        f((c("state") == "OPACO") & (c("opaque") > 0), "MATERIALES/MEDICAMENTOS SIN APERTURA", "B", c("opaque")),
        f(has("UNBUNDLING") & (c("hotel") > 0) & c("sure"), "HOTELERIA / ALIMENTACION COBRADA APARTE (UNBUNDLING)", "A", c("hotel")),
        f(has("UNBUNDLING") & (c("hotel") > 0) & ~c("sure") & ~has("OPACIDAD"), "POSIBLE HOTELERIA/ALIMENTACION", "B", c("hotel"))))
    return j.select("account", F.explode(fs).alias("f")).select("account", "f.*")


def global_decision(active: DataFrame, sums: DataFrame) -> DataFrame:
    """State of the account from its active hypotheses and the weight of its improper amount."""
    j = active.join(sums.select("account", "A"), "account", "left")
    has = lambda n: F.array_contains("active", n)
    heavy = F.coalesce("A", F.lit(0)) / F.greatest(F.col("copago"), F.lit(1)) > 0.25
    state = first_match([("PATRON_COMPATIBLE_CON_FRAUDE_PROBABLE", has("FRAUDE") & heavy), ("PRACTICAS_IRREGULARES_CON_OPACIDAD_ESTRUCTURAL", has("IRREGULAR") & has("OPACIDAD")),
                         ("COPAGO_INDETERMINADO_PARCIAL_POR_OPACIDAD", has("OPACIDAD"))], "AUDITORIA_CONCLUIDA")
    return j.select("account", state.alias("decision"))


def scoped_hypotheses(lines: DataFrame, items: DataFrame, test_accounts: DataFrame, min_items: int = 50, max_lines: int = 10) -> DataFrame:
    """Hypotheses with their scope: test account, generic line over a long bill, bundled surgery section, comfort section."""
    n_items = items.groupBy("account").agg(F.count(F.lit(1)).alias("n"))
    n_lines = lines.groupBy("account").agg(F.count(F.lit(1)).alias("m"))
    generic = search(F.col("description"), "material|insumo|medicamento|varios|sin bonific")
    h1 = lines.filter(generic).join(n_items, "account").join(n_lines, "account").filter((F.col("n") >= min_items) & (F.col("m") <= max_lines)).select(
        "account", F.lit("H1_OPACIDAD").alias("hypothesis"), F.lit("PAM_LINE").alias("scope_type"), F.col("line_id").alias("scope_key"), F.lit(0.85).alias("confidence"))
    d = F.col("description")
    per = items.groupBy("account", "section").agg(
        F.count_if(F.col("total") < 15000).alias("cheap"), F.count_if(search(d, "aposito|sutura|hoja|bisturi|guante|jeringa|aguj|cateter|sonda|compres|gasas")).alias("words"),
        F.count_if(search(d, "calcetin|media|toalla|agua|botella|termometro|vaso|jabon|shampoo|kit|confort")).alias("comfort"))
    row = lambda df, h, conf: df.select("account", F.lit(h).alias("hypothesis"), F.lit("SECTION").alias("scope_type"), F.col("section").alias("scope_key"), F.lit(conf).alias("confidence"))
    h2 = row(per.filter(search(F.col("section"), "pabellon|quirurg|intervencion|cirugia|honorario") & ((F.col("cheap") > 8) | (F.col("words") > 3))), "H2_UNBUNDLING", 0.8)
    h3 = row(per.filter("comfort > 0"), "H3_HOTELERIA", 0.9)
    h5 = test_accounts.select("account", F.lit("H5_TEST_CASE").alias("hypothesis"), F.lit("GLOBAL").alias("scope_type"), F.lit("").alias("scope_key"), F.lit(0.99).alias("confidence"))
    return h1.unionByName(h2).unionByName(h3).unionByName(h5)


# What each hypothesis enables and blocks.
ENABLES = {"H5_TEST_CASE": ["REGLAS_SINTETICAS_TEST"], "H1_OPACIDAD": ["TRANSPARENCIA_OPACIDAD"], "H2_UNBUNDLING": ["UNBUNDLING_IF319"],
           "H3_HOTELERIA": ["DETECCION_HOTELERIA"]}
BLOCKS = {"H5_TEST_CASE": ["TRANSPARENCIA_OPACIDAD", "UNBUNDLING_IF319", "CALCULO_TOPES_UF_VA_VAM", "VALIDACION_PRECIOS_UNITARIOS", "DETECCION_HOTELERIA"],
          "H1_OPACIDAD": ["UNBUNDLING_IF319", "VALIDACION_PRECIOS_UNITARIOS", "CALCULO_TOPES_UF_VA_VAM"]}
DANGEROUS = ["UNBUNDLING_IF319", "VALIDACION_PRECIOS_UNITARIOS", "CALCULO_TOPES_UF_VA_VAM"]
BASE_PRIORITY = {"H5_TEST_CASE": 100, "H1_OPACIDAD": 80}


def capabilities(hyps: DataFrame) -> DataFrame:
    """Capability rows with effect BLOCK or ENABLE and the rank of their hypothesis."""
    from saldo.functions.rules import lookup

    rows = []
    for effect, table in (("ENABLE", ENABLES), ("BLOCK", BLOCKS)):
        for h, caps in table.items():
            rows += [F.when(F.col("hypothesis") == h, F.struct(F.lit(effect).alias("effect"), F.lit(c).alias("capability"))) for c in caps]
    rank = lookup(F.col("hypothesis"), BASE_PRIORITY, 50) + F.col("confidence")
    return hyps.select("account", "hypothesis", "scope_type", "scope_key", rank.alias("priority"), F.explode(F.array_compact(F.array(*rows))).alias("c")).select(
        "account", "hypothesis", "scope_type", "scope_key", "priority", "c.effect", "c.capability")


def allowed(scopes: DataFrame, caps: DataFrame, capability: str) -> DataFrame:
    """Whether a capability may run in each scope: no block meets it, and dangerous ones are enabled there.

    Scopes meet when either is global, when type and key agree, or a line meets an item set (always).
    """
    c = caps.filter(F.col("capability") == capability)
    glob = c.groupBy("account").agg(*[F.bool_or((F.col("scope_type") == "GLOBAL") & (F.col("effect") == e)).alias(f"g_{e}") for e in ("BLOCK", "ENABLE")],
                                    *[F.bool_or(F.col("effect") == e).alias(f"any_{e}") for e in ("BLOCK", "ENABLE")],
                                    *[F.bool_or((F.col("scope_type") == s) & (F.col("effect") == e)).alias(f"{s}_{e}") for s in ("PAM_LINE", "ITEM_SET") for e in ("BLOCK", "ENABLE")])
    exact = c.groupBy("account", "scope_type", "scope_key").agg(*[F.bool_or(F.col("effect") == e).alias(f"e_{e}") for e in ("BLOCK", "ENABLE")])
    j = scopes.join(glob, "account", "left").join(exact, ["account", "scope_type", "scope_key"], "left")
    off = F.lit(False)

    def meets(e: str) -> Column:
        f = lambda n: F.coalesce(F.col(n), off)
        st = F.col("scope_type")
        return f(f"g_{e}") | f(f"e_{e}") | ((st == "GLOBAL") & f(f"any_{e}")) | ((st == "PAM_LINE") & f(f"ITEM_SET_{e}")) | ((st == "ITEM_SET") & f(f"PAM_LINE_{e}"))

    need = F.lit(capability in DANGEROUS)
    return j.select(*scopes.columns, (~meets("BLOCK") & (~need | meets("ENABLE"))).alias("allowed"))


def account_flags(items: DataFrame) -> DataFrame:
    """F-01 same code with several prices, F-02 visits, F-03 repeated lab markers or packages beside items, F-04 extension."""
    d = F.upper("description")
    code = F.coalesce(F.nullif(F.regexp_extract("description", r"(\d{2}-\d{2}-\d{3}-\d{2})", 1), F.lit("")), F.col("description"))
    prices = items.groupBy("account", code.alias("k")).agg((F.min("unit_price") != F.max("unit_price")).alias("p")).groupBy("account").agg(F.bool_or("p").alias("f01"))
    g = items.groupBy("account").agg(F.count_if(d.contains("VISITA")).alias("visits"), *[F.count_if(d.contains(k)).alias(f"lab_{i}") for i, k in enumerate(lx.LAB_MARKERS)],
                                     F.bool_or(d.rlike("SUMA DE|PAQUETE")).alias("pack"), F.count(F.lit(1)).alias("n"), F.bool_or(d.contains("AMPLIACION")).alias("f04"))
    labs = F.lit(0)
    for i in range(len(lx.LAB_MARKERS)):
        labs = labs + F.when(F.col(f"lab_{i}") > 4, 1).otherwise(0)
    labs = labs + F.when(F.col("pack") & (F.col("n") > 30), 1).otherwise(0)
    return g.join(prices, "account").select("account", "f01", (F.col("visits") > 5).alias("f02"), (labs > 0).alias("f03"), "f04",
                                            (F.col("f01") | (F.col("visits") > 10) | (labs > 2) | F.col("f04")).alias("high_risk"))


def account_rules(items: DataFrame, contracts: DataFrame, uncomputable: DataFrame) -> DataFrame:
    """C-01 empty contract, C-02 surgery without fees or stay without hospital cover, C-03 itemized drugs under a per-event clause, C-04 caps that cannot be computed.

    contracts: account, n_coverages, hospital_cover, per_event. uncomputable: account, uncomputable.
    """
    d = F.upper("description")
    fee = d.rlike("HM-|CIRU|AYUD|ANEST") & ~d.rlike("DER.PAB|DER. PAB|DERECHO PAB|EQUIPO PAB") & ~d.contains("VISITA")
    g = items.groupBy("account").agg(F.bool_or(d.rlike("DIA CAMA|NOCHE CAMA|DÍA CAMA|HABITACION|SALA DE")).alias("stay"),
                                     F.bool_or(d.rlike(r"DER\.PABELLON|DERECHO (DE )?PABELLON|DER\. PABELLON|RECUPERACION")).alias("room"), F.bool_or(fee).alias("fees"),
                                     F.count_if(d.rlike(r"MEDIC|INSUMO|SOL\.|AMP ")).alias("drugs"))
    j = g.join(contracts, "account").join(uncomputable, "account", "left")
    c = F.col
    return j.select("account", (c("n_coverages") == 0).alias("c01"), ((c("room") & ~c("fees")) | (c("stay") & ~c("hospital_cover"))).alias("c02"),
                    (c("per_event") & (c("drugs") > 50)).alias("c03"), F.coalesce("uncomputable", F.lit(False)).alias("c04"))


def rules_decision(rules: DataFrame, flag_rows: DataFrame) -> DataFrame:
    c = F.col
    j = rules.join(flag_rows, "account")
    d = first_match([("COPAGO_INDETERMINADO_POR_OPACIDAD", c("c04")), ("ERROR_CONTRATO_PROBADO", c("c01") | c("c02") | c("c03")),
                     ("ZONA_GRIS_REQUIERE_ANTECEDENTES", c("high_risk"))], "OK_VERIFICABLE")
    return j.select("account", d.alias("decision"))


def opacity_declarations(lines: DataFrame) -> DataFrame:
    """Types 1 group code unpaid, 2 not-covered code, 3 group code both paid and unpaid, for lines with copago."""
    from saldo.functions.text import bare_code

    c = F.col
    l = lines.withColumn("_code", bare_code(c("code")))
    paid = l.groupBy("account", "_code").agg(F.bool_or(c("bonif") > 0).alias("_paid"))
    group, uncovered = c("_code").isin(lx.AGGREGATOR_CODES), c("_code").isin(lx.NOT_COVERED_CODES)
    unpaid = c("bonif") == 0
    types = F.array_compact(F.array(F.when(group & unpaid & ~uncovered, F.lit(1)), F.when(uncovered, F.lit(2)), F.when(group & unpaid & c("_paid"), F.lit(3))))
    return l.filter("copago > 0").join(paid, ["account", "_code"]).select("account", "line_id", "copago", F.explode(types).alias("type"))


def exposed_amount(items: DataFrame, stated: DataFrame, single_events: DataFrame) -> DataFrame:
    """Amount of items that are not correct, plus what the bill states beyond its items, plus single-event additions."""
    bad = F.coalesce(F.col("etiology.type"), F.lit("CORRECTO")) != "CORRECTO"
    g = items.groupBy("account").agg(F.count_if(bad).alias("flagged"), total(F.when(bad, F.col("total"))).alias("amount"), F.sum("total").alias("itemized"))
    j = g.join(stated, "account").join(single_events, "account", "left")
    rest = F.greatest(F.lit(0), F.col("stated_total") - F.col("itemized"))
    return j.select("account", (F.col("flagged") + F.coalesce("events", F.lit(0))).alias("flagged"), rest.alias("residual"), (F.col("amount") + rest + F.coalesce("addition", F.lit(0))).alias("exposed"))


def section_tree(items: DataFrame) -> DataFrame:
    """Sections and subfamilies with counts, in the order they first appear."""
    leaf = items.groupBy("account", "section", "subfamily").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    node = leaf.groupBy("account", "section").agg(F.min("first").alias("section_first"), F.sum("n").alias("section_n"))
    return leaf.join(node, ["account", "section"]).select("account", "section", "section_first", "section_n", "subfamily", F.col("first").alias("subfamily_first"), "n")


def rally_totals(lines: DataFrame, stated: DataFrame, tolerance: int = 5) -> DataFrame:
    """Copago per cost class (unclassified counts as IV), the difference to the stated copago and the financial summary."""
    from saldo.operators import classify as K

    k = F.coalesce(K.cost_class(F.col("description"), F.lit("PAM")), F.lit("IV"))
    l = lines.filter("copago > 0").withColumn("_k", k)
    g = l.groupBy("account").agg(*[total(F.when(F.col("_k") == n, F.col("copago"))).alias(n) for n in ("I", "II", "III", "IV")], F.sum("copago").alias("total"))
    gap = F.col("total") - F.col("stated")
    return g.join(stated, "account").select("account", "I", "II", "III", "IV", "total", F.when(F.abs(gap) < tolerance, 0).otherwise(gap).cast("long").alias("delta"),
                                            (F.col("I") + F.col("II")).alias("confirmed"), (F.col("III") + F.col("IV")).alias("disputed"), F.col("IV").alias("indeterminate"))


def rally_lines(lines: DataFrame) -> DataFrame:
    """Lines of each cost class by amount, largest first."""
    from saldo.operators import classify as K, sequence

    k = F.coalesce(K.cost_class(F.col("description"), F.lit("PAM")), F.lit("IV"))
    l = lines.filter("copago > 0").withColumns({"cost_class": k, "_desc": -F.col("copago")})
    return sequence.number(l, ["account", "cost_class"], ["_desc", "line_id"], F.floor(F.col("_desc") / 1000000), name="n").select("account", "cost_class", "n", "line_id", "copago")
