"""Contract rules: which rule applies to a line, and what it should have paid.

Rules carry contract_id, rule_id, pos, domain, modality, pct, cap_kind, cap_value, clinic, text.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.caps import strict_cap
from saldo.functions.money import round_half_up
from saldo.functions.rules import first_match, lookup, score
from saldo.functions.text import normalize_strict, normalize_upper
from saldo.operators import classify as K
from saldo.operators import sequence
from saldo.operators.containment import contained, either_way
from saldo.operators.texts import FEW
from saldo.session import checkpoint

# Text traits of a line that the affinity of a rule depends on.
TRAITS = {"psico": "psicoterapia", "radio": "radioterapia", "kine": "kinesi", "drug": "clinico|farmaco|medicamento",
          "supply": "material|insumo|gasa", "pref": "preferente|red pref", "free": "libre eleccion|libre elec"}


def _traits() -> dict[str, Column]:
    d = normalize_strict(F.col("description"))
    return {f"t_{n}": F.coalesce(d.rlike(p), F.lit(False)) for n, p in TRAITS.items()}


def affinity() -> Column:
    """Score of a rule (normalized _text and _clinic, modality) for a line (traits, who, hospital)."""
    c = F.col
    t, clinic = c("_text"), c("_clinic")
    here = (clinic != "") & (c("who") != "") & (c("who").contains(clinic) | clinic.contains(c("who")))
    hospital = t.rlike("hospitalizacion|clinica|pabellon|dia cama|quirurgico")
    pref, free = c("t_pref"), c("t_free") & ~c("t_pref")
    return score([
        (1000, t.contains("psicoterapia") & c("t_psico")), (1000, t.contains("radioterapia") & c("t_radio")), (1000, t.contains("kinesi") & c("t_kine")),
        (500, t.contains("medicamento") & c("t_drug")), (500, t.contains("insumo") & c("t_supply")),
        (5000, pref & (c("modality") == "preferente")), (-1000, pref & (c("modality") == "libre_eleccion")),
        (5000, free & (c("modality") == "libre_eleccion")), (-1000, free & (c("modality") == "preferente")),
        (2000, c("hospital") & hospital), (-500, c("hospital") & t.rlike("ambulatorio|visita")), (500, ~c("hospital") & t.contains("ambulatorio")),
        (10000, here), (-3000, t.contains("psicoterapia") & ~c("t_psico")), (-3000, t.contains("radioterapia") & ~c("t_radio"))])


def choose_rules(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Lines with the rule of their domain: best affinity above zero, else the lowest percent.

    Lines carry contract_id, domain, description, provider_name, hospital. Lines that look the same to the
    rules are scored once, so the work grows with the kinds of lines, not with the lines.
    """
    return choose_many(lines, rules, {"": (F.col("domain"), F.col("hospital"))})


FIELDS = ["rule_id", "pct", "cap_kind", "cap_value"]


def choose_many(lines: DataFrame, rules: DataFrame, ways: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Lines with the rule of each way to read them: prefix of its columns to (domain, hospital). All ways share one scoring of kinds and one join."""
    read = {f"_{n}{i}": c for i, w in enumerate(ways.values()) for n, c in zip(("domain", "hospital"), w)}
    looks = _traits() | {"who": normalize_strict(F.col("provider_name"))}
    t = lines.withColumns(read)
    kind = ["contract_id", "description", "provider_name", *read]
    kinds = checkpoint(t.select(*kind).distinct().limit(FEW + 1))
    few = kinds.count() <= FEW
    if few:
        kinds = kinds.withColumns(looks)
    else:
        t = t.withColumns(looks)
        kind = ["contract_id", *looks, *read]
        kinds = t.select(*kind).distinct()
    each = [F.struct(F.lit(i).alias("way"), F.col(f"_domain{i}").alias("domain"), F.col(f"_hospital{i}").alias("hospital")) for i in range(len(ways))]
    asked = kinds.select("*", F.explode(F.array(*each)).alias("w")).select("*", "w.*").filter("hospital is not null")
    plain = rules.withColumnRenamed("pos", "rule_pos").withColumns({"_text": normalize_strict(F.col("text")), "_clinic": normalize_strict(F.col("clinic"))})
    s = asked.join(plain, ["contract_id", "domain"]).withColumn("_score", affinity())
    g = s.groupBy(*kind, "way").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.struct("_score", (-F.col("rule_pos")).alias("_first"), *FIELDS)).alias("_best"),
        F.min(F.struct(F.coalesce("pct", F.lit(0.0)).alias("_low"), "rule_pos", *FIELDS)).alias("_worst"))
    use_best = (F.col("_n") == 1) | (F.col("_best._score") > 0)
    by = first_match([("MODALIDAD", F.col("_n") == 1), ("KEYWORDS", F.col("_best._score") > 0)], "FALLBACK")
    picked = F.struct(by.alias("matched_by"), *[F.when(use_best, F.col(f"_best.{f}")).otherwise(F.col(f"_worst.{f}")).alias(f) for f in FIELDS])
    rows = g.groupBy(*kind).agg(*[F.max(F.when(F.col("way") == i, picked)).alias(f"_w{i}") for i in range(len(ways))])
    out = [F.col(f"_w{i}.{f}").alias(p + f) for i, p in enumerate(ways) for f in ("matched_by", *FIELDS)]
    rows = rows.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(kind)})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(kind)])
    return t.join(F.broadcast(rows) if few else rows, same, "left").select(*lines.columns, *out)


def cap_amount(kind: Column, value: Column, unit_value: Column | float = lx.UNIT_FALLBACK) -> Column:
    """Cap in money; null where there is none or the unit has no rate."""
    unit = unit_value if isinstance(unit_value, Column) else F.lit(float(unit_value))
    rate = first_match([(unit, kind == "UF")] + [(F.lit(v), kind == k) for k, v in lx.UNIT_RATE.items()], None)
    return value * rate


def check_payment(chosen: DataFrame, unit_value: Column | float = lx.UNIT_FALLBACK) -> DataFrame:
    """Expected payment of the chosen rule against the line, with tolerance max(500, 0.1 %)."""
    c = F.col
    cap = cap_amount(c("cap_kind"), c("cap_value"), unit_value)
    raw = F.floor(c("valor") * (c("pct") / 100) + 0.5)
    expected = F.least(raw, cap)
    copago = c("valor") - expected
    delta = c("copago") - copago
    tolerance = F.greatest(F.lit(500), F.floor(c("valor") * 0.001 + 0.5))
    cap_state = first_match([("SIN_TOPE", c("cap_kind").isNull() | (c("cap_kind") == "SIN_TOPE_EXPRESO")), ("TOPE_NO_VERIFICABLE", cap.isNull()),
                             ("TOPE_EXCEDIDO", c("bonif") > cap * 1.02)], "TOPE_OK")
    unknown = c("rule_id").isNull() | c("pct").isNull()
    state = first_match([("NO_VERIFICABLE_POR_CONTRATO", unknown), ("INFRA_BONIFICACION", delta > tolerance), ("TOPE_EXCEDIDO", cap_state == "TOPE_EXCEDIDO")],
                        "VERIFICABLE_OK")
    known = lambda x: F.when(~unknown, x)
    return chosen.withColumns({
        "check_state": state, "cap_state": known(cap_state), "expected_bonif": known(expected.cast("double")), "expected_copago": known(copago.cast("double")),
        "excess": known(F.greatest(F.lit(0.0), delta.cast("double"))), "tolerance": known(tolerance.cast("double"))})


OTHER = ("HONORARIOS", "HOSPITALIZACION")


def _alternatives() -> Column:
    """What the first other domain with a rule says, for every pair of rows of the line: array of struct(alt_domain, alt_pct, alt_copago).

    Rules come with the domain's name before their columns. Where a line's id does not repeat, the array has one element.
    """
    c = F.col
    line = Window.partitionBy("line_id")

    def under(domain: str) -> Column:
        cap = cap_amount(c(f"{domain}cap_kind"), c(f"{domain}cap_value"))
        expected = F.least(F.floor(c("valor") * (c(f"{domain}pct") / 100) + 0.5), cap)
        known = c(f"{domain}rule_id").isNotNull() & c(f"{domain}pct").isNotNull()
        says = F.when(known, F.struct(F.lit(domain).alias("alt_domain"), c(f"{domain}pct").alias("alt_pct"), (c("valor") - expected).cast("double").alias("alt_copago")))
        all_ = F.collect_list(says).over(line)
        return F.when((F.size(all_) == 0) | c("line_id").isNull(), F.array(F.when(F.lit(False), says))).otherwise(all_)

    first, second = (under(d) for d in OTHER)
    return F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.coalesce(a, b))))


def _other_ways() -> dict[str, tuple[Column, Column]]:
    return {d: (F.lit(d), F.lit(True)) for d in OTHER}


def alternative_check(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """The line evaluated again as fees, else as hospitalization: alt_domain, alt_pct, alt_copago."""
    chosen = choose_many(lines, rules, _other_ways())
    return chosen.withColumn("_a", _alternatives()).select("line_id", F.explode("_a").alias("a")).select("line_id", "a.*")


def checked_both_ways(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``check_payment`` of the chosen rules joined with ``alternative_check``; lines and rules meet once."""
    chosen = choose_many(lines, rules, {"": (F.col("domain"), F.col("hospital"))} | _other_ways()).filter("line_id is not null")
    n = F.count(F.lit(1)).over(Window.partitionBy("line_id")).cast("int")
    both = chosen.withColumns({"_a": _alternatives(), "_n": n}).withColumn("_a", F.explode(F.flatten(F.array_repeat("_a", F.col("_n")))))
    return check_payment(both.select(*lines.columns, "matched_by", *FIELDS, "_a.*"))


def rule_exists(lines: DataFrame, rules: DataFrame) -> DataFrame:
    known = rules.select("contract_id", "domain").distinct().withColumn("_k", F.lit(True))
    return lines.join(known, ["contract_id", "domain"], "left").select("line_id", F.col("_k").isNotNull().alias("has_rule"))


def best_rules(rules: DataFrame) -> DataFrame:
    """One rule per domain and modality: capped first, then the higher percent; a missing cap is borrowed from a rule that has only a cap."""
    c = F.col
    capped = c("cap_value").isNotNull() | (c("cap_kind") == "SIN_TOPE_EXPRESO")
    key = ["contract_id", "domain", "modality"]
    order = F.struct((~capped).cast("int"), -F.coalesce("pct", F.lit(0.0)), "pos")
    with_pct = F.when(c("pct").isNotNull(), order)
    cap_only = F.when(capped & c("pct").isNull(), c("pos"))
    g = rules.groupBy(*key).agg(
        F.min_by(F.struct("rule_id", "pct", "cap_kind", "cap_value", capped.alias("capped")), F.coalesce(with_pct, F.struct(F.lit(2), F.lit(0.0), c("pos")))).alias("r"),
        F.min_by(F.struct("cap_kind", "cap_value"), cap_only).alias("lent"))
    borrow = ~c("r.capped") & c("lent").isNotNull()
    return g.select(*key, c("r.rule_id").alias("rule_id"), c("r.pct").alias("pct"), F.when(borrow, c("lent.cap_kind")).otherwise(c("r.cap_kind")).alias("cap_kind"),
                    F.when(borrow, c("lent.cap_value")).otherwise(c("r.cap_value")).alias("cap_value"))


def merge_items(items: DataFrame) -> DataFrame:
    """Distinct rules per benefit, keyed by class and normalized name. Rules stay rows."""
    return items.select("contract_id", F.upper("benefit_class").alias("benefit_class"), normalize_strict(F.col("benefit")).alias("benefit"),
                        "pct", "cap_kind", "cap_value").distinct()


def provider_network(providers: DataFrame, aliases: DataFrame) -> DataFrame:
    """Preferred when the provider's name contains an alias or the reverse, else free choice."""
    p = providers.select("provider", F.upper("name").alias("p"))
    a = aliases.select(F.upper("alias").alias("a")).distinct()
    pairs = either_way(p.select(F.col("p").alias("t")), a.select(F.col("a").alias("t"))).toDF("p", "a")
    hit = p.join(pairs, "p", "left_semi").select("provider", F.lit(True).alias("_h"))
    return providers.join(hit, "provider", "left").select("provider", F.when(F.col("_h"), "PREFERENTE").otherwise("LIBRE_ELECCION").alias("network"))


TARGETS = ["HONORARIOS", "CIRUGIA", "QUIRURGICO", "HOSPITALARIO"]


def coverage_factor(coverages: DataFrame, modality: str = "LIBRE_ELECCION", default: float = 0.70) -> DataFrame:
    """Share covered per contract: first target present, preferred modality, first row; 0.70 without any."""
    t = F.upper("benefit")
    target = first_match([(i, t.contains(n)) for i, n in enumerate(TARGETS)], None)
    other = F.when(F.upper("modality") == modality, 0).otherwise(1)
    usable = target.isNotNull() & (F.col("pct") > 0)
    g = coverages.groupBy("contract_id").agg(F.min_by("pct", F.when(usable, F.struct(target.alias("t"), other.alias("m"), F.col("pos")))).alias("pct"))
    return g.select("contract_id", F.coalesce(F.when(F.col("pct") > 1, F.col("pct") / 100).otherwise(F.col("pct")), F.lit(default)).alias("factor"))


def cap_rules_by_code(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Cap rule of a fee by code prefix: the rule's trigger codes, its modality first, then its order.

    Codes of one length are cut to the length of every trigger, so a prefix becomes a key.
    """
    trig = rules.withColumn("trigger", F.explode(F.split("triggers", r"\s*,\s*"))).filter("trigger <> ''").withColumn("len", F.length("trigger"))
    lens = F.sequence(F.lit(1), F.length("code"))
    cut = items.withColumn("len", F.explode(lens)).withColumn("trigger", F.expr("substring(code, 1, len)"))
    j = cut.join(trig.select("trigger", F.col("modality").alias("rule_modality"), F.col("pos").alias("rule_pos"), "rule_id", "cap_value"), "trigger")
    order = F.struct((F.col("rule_modality") != F.col("modality")).cast("int"), "rule_pos")
    best = j.groupBy("code", "modality").agg(F.min_by(F.struct("rule_id", "cap_value"), order).alias("b"))
    return best.select("code", "modality", "b.rule_id", "b.cap_value")


def fee_cap_check(fees: DataFrame) -> DataFrame:
    """Fees carry bonif, factor, unit_value, coverage, confidence. Theoretical cap = unit x factor x coverage, +-1.5."""
    c = F.col
    theory = c("unit_value") * c("factor") * c("coverage")
    low = (c("confidence") == "BAJA") | c("unit_value").isNull()
    case = first_match([("SIN_TOPE", c("factor").isNull()), ("NO_VERIFICABLE", low | c("coverage").isNull()), ("CUMPLE", F.abs(c("bonif") - theory) <= 1.5),
                        ("CUMPLE_EXCEDE", c("bonif") > theory + 1.5)], "DISCREPANCIA")
    return fees.withColumns({"theory": theory, "verdict": case, "applies": c("factor").isNotNull(), "met": case.isin("CUMPLE", "CUMPLE_EXCEDE")})


def resolve_code(items: DataFrame, schedule: DataFrame) -> DataFrame:
    """Exact lookup of a cleaned code in the fee schedule."""
    s = schedule.groupBy("code").agg(F.min_by("description", "pos").alias("schedule_text"))
    return items.withColumn("code", F.regexp_replace("code", "[^0-9]", "")).join(s, "code", "left")


def resolve_text(texts: DataFrame, schedule: DataFrame, share: float = 0.6) -> DataFrame:
    """Fee of a free text, in tiers: code in the text, same text, contained text, shared words.

    Works on the distinct texts. Entries are reached by code, by text or by words of four letters or more.
    """
    q0 = texts.select("text").distinct()
    code = F.regexp_replace(F.regexp_extract("text", r"(\d{2}\s?\d{2}\s?\d{3})", 1), r"\s", "")
    q = q0.select("text", F.when(code != "", code).alias("code"), normalize_upper(F.regexp_replace(F.split("text", r"\.\.\.|\(|-").getItem(0), r"\b\d{6,8}\b", "")).alias("q"))
    s = schedule.select(F.col("code").alias("s_code"), F.col("pos").alias("s_pos"), normalize_upper(F.col("description")).alias("s"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 3))
    qn = q.filter(F.length("q") >= 3)
    one = F.lit(1.0)
    by_code = q.filter("code is not null").join(s, F.col("code") == F.col("s_code")).select("text", F.lit(0).alias("tier"), one.alias("share"), "s_pos", "s_code")
    by_text = qn.join(s, F.col("q") == F.col("s")).select("text", F.lit(1).alias("tier"), one.alias("share"), "s_pos", "s_code")
    qw = qn.select("text", "q", F.size(words(F.col("q"))).alias("n"), F.explode(words(F.col("q"))).alias("w"))
    sw = s.select("*", F.explode(words(F.col("s"))).alias("w"))
    met = qw.join(sw, "w").groupBy("text", "n", "s_pos", "s_code").agg(F.count(F.lit(1)).alias("k"))
    qt, st = qn.select(F.col("q").alias("t")), s.select(F.col("s").alias("t"))
    ways = contained(st, qt).toDF("s", "q").union(contained(qt, st.filter(F.length("t") > 5)).select("inner", "outer")).distinct()
    inside = qn.join(ways, "q").join(s, "s").select("text", F.lit(2).alias("tier"), one.alias("share"), "s_pos", "s_code")
    shared = met.filter(F.col("k") / F.col("n") >= share).select("text", F.lit(3).alias("tier"), (F.col("k") / F.col("n")).alias("share"), "s_pos", "s_code")
    every = by_code.unionByName(by_text).unionByName(inside).unionByName(shared)
    best = every.groupBy("text").agg(F.min(F.struct("tier", (-F.col("share")).alias("r"), "s_pos", "s_code")).alias("b"))
    return best.select("text", F.col("b.s_code").alias("code"), F.col("b.tier").alias("tier"))


def enrich_descriptions(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Vague line texts take the text of the last bill item with the same code, else with the same copago."""
    last = lambda k: items.filter(F.col(k).isNotNull()).groupBy("account", k).agg(F.max_by("description", "pos").alias(f"by_{k}"))
    j = lines.join(last("code"), ["account", "code"], "left").join(last("copago"), ["account", "copago"], "left")
    vague = F.col("description").rlike("(?i)MEDICAMENTO|INSUMO|MATERIAL") | (F.length("description") < 5)
    found = F.coalesce("by_code", "by_copago")
    return j.select(*lines.columns, F.when(vague & found.isNotNull(), F.concat(found, F.lit(" (PAM: "), "description", F.lit(")"))).otherwise(F.col("description")).alias("enriched"))


def infer_unit_value(anchors: DataFrame, opacity: DataFrame) -> DataFrame:
    """Unit value per account from fees of known factor: mean, independent codes, confidence and state.

    anchors: account, code, bonif. opacity: account, lines, vague, opaque_block.
    """
    c = F.col
    factor = lookup(c("code"), lx.FEE_FACTORS, None)
    usable = c("code").isin(lx.ANCHOR_CODES) & (c("bonif") > 0)
    unit = F.when(c("code") == "1103057", "AC2").otherwise("VA")
    implied = F.floor(c("bonif") / factor + 0.5)
    a = anchors.filter(usable).select("account", "code", unit.alias("unit"), implied.alias("implied"))
    off = contradictions(a)
    g = a.groupBy("account").agg(F.avg("implied").alias("mean"), F.count_distinct("code").alias("independent"))
    j = opacity.join(g, "account", "left").join(off, "account", "left")
    share = c("vague") / F.greatest(c("lines"), F.lit(1))
    opaque = (share > 0.35) | c("opaque_block")
    bad = F.coalesce("contradictory", F.lit(False))
    found = c("mean").isNotNull() & ~bad
    state = first_match([("NO_VERIFICABLE_POR_OPACIDAD", opaque), ("NO_VERIFICABLE_POR_CONTRATO", bad | ~found)], "VERIFICABLE")
    conf = first_match([("ALTA", found & (c("independent") >= 2)), ("MEDIA", found)], "BAJA")
    trust = first_match([(F.greatest(F.lit(0.1), F.lit(0.5) - share), opaque), (F.lit(0.2), bad), (F.lit(1.0), found & (c("independent") >= 2)), (F.lit(0.75), found)], F.lit(0.3))
    return j.select("account", F.when(found, round_half_up(c("mean"))).otherwise(F.lit(lx.UNIT_FALLBACK_OTHER)).cast("long").alias("unit_value"), conf.alias("confidence"),
                    state.alias("state"), trust.alias("trust"))


def contradictions(anchors: DataFrame) -> DataFrame:
    """Accounts whose anchors disagree: more than 5 % off the mean of their unit, or several units."""
    per_unit = anchors.groupBy("account", "unit").agg(F.avg("implied").alias("m"), F.min("implied").alias("lo"), F.max("implied").alias("hi"), F.count(F.lit(1)).alias("n"))
    wide = (F.col("n") >= 2) & (F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) / F.col("m") > 0.05)
    return per_unit.groupBy("account").agg((F.bool_or(wide) | (F.count(F.lit(1)) > 1)).alias("contradictory"))


def concepts(lines: DataFrame) -> DataFrame:
    """Benefit lines grouped by clean name: the first line is the primary one; alerts as flags."""
    from saldo.functions.text import clean_benefit_name

    g = lines.groupBy("contract_id", clean_benefit_name(F.col("name")).alias("concept"))
    return g.agg(F.min_by("line_id", "pos").alias("primary"), F.min_by("pct", "pos").alias("pct"), F.count(F.lit(1)).alias("lines"), F.bool_or("locked").alias("locked"),
                 F.bool_or("empty_cell").alias("void"), F.bool_or("no_cap").alias("uncapped"))


def option_issues(options: DataFrame) -> DataFrame:
    """Checker of benefit options: provider shared by the 80 and 90 % tiers, missing percent, broken cut, collapsed caps.

    options: row_id, option_id, modality, pct, providers (array), cut, cap_event, cap_annual.
    """
    c = F.col
    pref = c("modality") == "preferente"
    each = options.filter(pref & c("pct").isin(80, 90)).select("row_id", "pct", F.explode("providers").alias("p")).distinct()
    mixed = each.groupBy("row_id", "p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row_id").distinct().withColumn("_m", F.lit(True))
    has = F.size("providers") > 0
    g = options.groupBy("row_id").agg(
        F.count_if(pref & has & c("pct").isNull()).alias("no_percent"), (F.bool_or("cut") & F.bool_or(pref & has)).alias("broken_cut"),
        F.count_if(c("cap_event").isNotNull() & (c("cap_event") == c("cap_annual"))).alias("collapsed"))
    j = g.join(mixed, "row_id", "left")
    m = F.coalesce("_m", F.lit(False))
    critical = m.cast("int") + c("broken_cut").cast("int")
    return j.select("row_id", m.alias("mixed"), "no_percent", "broken_cut", "collapsed", K.penalty_score(critical, c("collapsed"), c("no_percent")).alias("score"))


def canonical_coverages(raw: DataFrame) -> dict[str, DataFrame]:
    """Canonical tables from raw benefit rows with modalities: coverages, caps (per event and annual), copays.

    raw: contract_id, pos, category, benefit, modalities ARRAY<STRUCT<kind, pct, cap, annual_cap, copay>>.
    """
    norm = normalize_strict(F.concat_ws(" ", "category", "benefit"))
    scope = first_match([("hospitalario", norm.rlike("hosp|dia cama|pabellon|quirurg")), ("ambulatorio", norm.rlike("amb|consulta|examen|laborat")),
                         ("mixto", norm.rlike("restringida|libre|extra"))], "desconocido")
    m = raw.select("contract_id", "pos", "benefit", scope.alias("scope"), F.explode("modalities").alias("m"))
    kind = lookup(F.col("m.kind"), {"LIBRE_ELECCION": "libre_eleccion", "PREFERENTE": "preferente"}, "desconocido")
    base = m.withColumn("modality", kind)
    cover = base.select("contract_id", "pos", "benefit", "scope", "modality", F.col("m.pct").alias("pct"))
    event = base.select("contract_id", "pos", "benefit", "scope", "modality", F.lit("por_evento").alias("applies"), strict_cap(F.col("m.cap")).alias("c"))
    annual_text = F.coalesce("m.annual_cap", F.when(F.col("modality") != "desconocido", F.lit("SIN TOPE")))
    annual = base.filter(annual_text.isNotNull()).select("contract_id", "pos", "benefit", "scope", "modality", F.lit("anual").alias("applies"), strict_cap(annual_text).alias("c"))
    caps = event.unionByName(annual).select("*", "c.*").drop("c")
    copay = base.filter(F.col("m.copay").isNotNull()).select("contract_id", "pos", "benefit", "modality", strict_cap(F.col("m.copay"))["value"].alias("value"),
                                                             F.coalesce(strict_cap(F.col("m.copay"))["unit"], F.lit("PESOS")).alias("unit"))
    return {"coverages": cover, "caps": caps, "copays": copay}


def rule_texts(texts: DataFrame) -> DataFrame:
    """Exclusions, deductibles (amount in UF) and application rules of a contract's literal texts."""
    c = F.upper("category")
    kind = first_match([("EXCLUSION", c.contains("EXCLUSI")), ("DEDUCIBLE", c.contains("DEDUCIBLE"))], "REGLA")
    uf = F.translate(F.regexp_extract("text", r"(?i)(\d+[,.]?\d*)\s*UF", 1), ",", ".").try_cast("double")
    return texts.select("contract_id", "pos", kind.alias("kind"), F.when(kind == "DEDUCIBLE", uf).alias("value"),
                        F.when(kind == "DEDUCIBLE", F.when(F.lower("text").contains("anual"), "anual").otherwise("desconocido")).alias("applies"))


def simulate_coverage(items: DataFrame, assignments: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """What every contract would cover of the bill: items summed by section, the first assignment of the section's rows.

    The bill meets the contracts as a handful of section totals, never item by contract.
    """
    by_section = items.groupBy("section").agg(F.sum("total").alias("total"))
    rows = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    m = by_section.select("section", "total", F.explode_outer(F.try_element_at(rows, F.col("section"))).alias("row_id"))
    first = assignments.groupBy("contract_id", "row_id").agg(F.min(F.struct("pos", "value", "unit")).alias("a"))
    hit = first.join(m.filter("row_id is not null"), "row_id").groupBy("contract_id", "section", "total").agg(F.min("a").alias("a"))
    share = first_match([(F.lit(1.0), F.lower("a.value").contains("sin tope")), (F.col("a.value").try_cast("double") / 100, F.col("a.unit") == "%")], F.lit(0.5))
    covered = hit.groupBy("contract_id").agg(F.sum(F.col("total") * F.coalesce(share, F.lit(0.0))).alias("covered"))
    grand = by_section.agg(F.sum("total").alias("total"))
    names = assignments.select("contract_id").distinct().join(covered, "contract_id", "left").withColumn("_k", F.lit(1))
    return names.join(grand.withColumn("_k", F.lit(1)), "_k").select(
        "contract_id", "total", round_half_up(F.col("covered")).alias("covered"), (F.col("total") - round_half_up(F.col("covered"))).alias("patient"),
        round_half_up(F.coalesce("covered", F.lit(0.0)) / F.col("total") * 100).alias("pct"))


def coverage_by_category(rules: DataFrame) -> DataFrame:
    """Listing of a contract's rules by category, categories in the order they first come: adds category_no, n (in the category) and the table row.

    rules: contract_id, pos, category, item and, where there are any, modality, coverage, cap, copay, note. A blank category is SIN CATEGORÍA.
    """
    shown = F.when(F.coalesce(F.col("category"), F.lit("")) == "", "SIN CATEGORÍA").otherwise(F.col("category"))
    r = rules.withColumn("category", shown)
    first = r.groupBy("contract_id", "category").agg(F.min("pos").alias("_first"))
    # A contract's categories are a few rows, its rules may be many.
    first = first.withColumn("category_no", F.row_number().over(Window.partitionBy("contract_id").orderBy("_first"))).drop("_first")
    n = sequence.number(r, ["contract_id", "category"], ["pos"], sequence.by_pos(), name="n")
    cell = lambda c, blank: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(blank)) if c in rules.columns else F.lit(blank)
    cells = [cell("item", "-"), cell("modality", "-"), cell("coverage", "-"), cell("cap", "-"), cell("copay", "-"), cell("note", "")]
    return n.join(first, ["contract_id", "category"]).withColumn("text", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))
