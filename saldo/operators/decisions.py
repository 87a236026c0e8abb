"""Decisions per settlement line: precedents, doctrine, evidence tiers and frozen overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.ids import fingerprint
from saldo.functions.rules import first_match, let
from saldo.functions.text import normalize_spaced
from saldo.operators import sequence


def contract_fingerprint(coverages: DataFrame) -> DataFrame:
    """Hash of each contract's coverage set, whatever the order of its rows.

    A contract's rows are hashed one by one and combined as an order-free digest of counts, so no contract
    is gathered into one value.
    """
    row = F.xxhash64(normalize_spaced(F.col("domain")), normalize_spaced(F.col("modality")), F.col("pct"), F.col("cap_kind"), F.col("cap_value"))
    g = coverages.select("contract_id", row.alias("h")).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_000_007))).alias("s"))
    return g.select("contract_id", fingerprint(F.col("n"), F.col("x"), F.col("s")).alias("contract_hash"))


def line_fingerprint(code: Column, description: Column, bonif: Column, copago: Column) -> Column:
    """Hash of what makes two settlement lines the same kind of fact."""

    def parts(d: Column) -> Column:
        kind = first_match([("MED", d.rlike("MEDIC|FARMAC|DROGA")), ("MAT", d.contains("MATER")), ("INS", d.contains("INSUM")), ("VAR", d.rlike("VARIOS|OTROS|MISCELAN"))], "OTRO")
        generic = d.rlike("MATERIAL|MEDICAMENTO|INSUMO|VARIOS|PRESTACIONES SIN BONIF")
        return fingerprint(code, kind, (bonif == 0).cast("int"), (copago > 0).cast("int"), generic.cast("int"))

    return let(normalize_spaced(description), parts)


def guards_pass(features: Column, requires: Column, forbids: Column) -> Column:
    return (F.size(F.array_except(requires, features)) == 0) & ~F.arrays_overlap(forbids, features)


def precedent_lookup(lines: DataFrame, precedents: DataFrame) -> DataFrame:
    """Most confident precedent of the same contract and fact whose guards pass.

    Lines with equal hashes and features are looked up once.
    """
    key = ["contract_hash", "fact_hash"]
    kinds = lines.select(*key, "features").distinct()
    hit = kinds.join(precedents, key).filter(guards_pass(F.col("features"), F.col("requires"), F.col("forbids")))
    best = hit.groupBy(*key, "features").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "id", "category")).alias("b"))
    found = best.select(*key, "features", F.col("b.id").alias("precedent"), F.col("b.category").alias("precedent_category"), (-F.col("b.c")).alias("precedent_confidence"))
    return lines.join(found, [*key, "features"], "left")


# Doctrine rules in priority order: id, required feature, forbidden features, category, confidence.
DOCTRINE = [("C01_INCUMPLIMIENTO_CONTRATO", "IC_BREACH", [], "A", 1.0), ("C02_UNBUNDLING", "UB_DETECTED", [], "A", 0.95),
            ("C03_INFERENCIA_TECNICA", "HT_DETECTED", [], "A", 0.90), ("C05_OPACIDAD_REAL", "OP_DETECTED", ["IC_BREACH", "UB_DETECTED", "HT_DETECTED"], "Z", 0.85)]


def _applies(features: Column, required: str, forbidden: list[str]) -> Column:
    ok = F.array_contains(features, required)
    for f in forbidden:
        ok = ok & ~F.array_contains(features, f)
    return ok


def doctrine(features: Column) -> Column:
    """struct(rule, category, confidence) of the first doctrine rule, null without one."""
    return first_match([(F.struct(F.lit(i).alias("rule"), F.lit(c).alias("category"), F.lit(v).alias("confidence")), _applies(features, r, no)) for i, r, no, c, v in DOCTRINE], None)


def all_doctrine(features: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_applies(features, r, no), F.lit(i)) for i, r, no, _, _ in DOCTRINE]))


def heuristic(features: Column) -> Column:
    has = lambda n: F.array_contains(features, n)
    d = lambda c, v: F.struct(F.lit(c).alias("category"), F.lit(v).alias("confidence"))
    return first_match([(d("B", 0.65), has("BONIF_0") & has("COPAGO_POS")), (d("B", 0.60), has("GENERIC_PAM_LINE") & has("COPAGO_POS"))], d("Z", 0.50))


def tiered(lines: DataFrame) -> DataFrame:
    """Decision by precedent, doctrine, heuristic. Needs precedent columns and features; lines may be kinds of lines."""
    c = F.col
    tier = lambda cat, conf, source: F.struct(cat.alias("category"), conf.cast("double").alias("confidence"), F.lit(source).alias("source"))
    rules = F.struct(doctrine(c("features")).alias("doc"), heuristic(c("features")).alias("heu"))
    d = let(rules, lambda r: first_match([
        (tier(c("precedent_category"), c("precedent_confidence"), "PRECEDENTE"), c("precedent").isNotNull()),
        (tier(r["doc"]["category"], r["doc"]["confidence"], "DOCTRINA"), r["doc"].isNotNull())], tier(r["heu"]["category"], r["heu"]["confidence"], "HEURISTICA")))
    return lines.withColumn("_d", d).select(*[x for x in lines.columns], "_d.*")


def evidence_first(decisions: DataFrame) -> DataFrame:
    """Decisions of the lower tiers, with the category of financial evidence put before them where there is any."""
    shown = F.col("financial_category").isNotNull()
    return decisions.withColumns({"category": F.coalesce("financial_category", "category"), "confidence": F.when(shown, F.lit(0.99)).otherwise(F.col("confidence")),
                                  "source": F.when(shown, "FINANCIERO").otherwise(F.col("source"))})


def decide(lines: DataFrame) -> DataFrame:
    """Decision by tiers: financial evidence, precedent, doctrine, heuristic. Needs financial_category, precedent columns, features."""
    return evidence_first(tiered(lines))


def fee_evidence(lines: DataFrame, fees: DataFrame, tolerance: int = 500) -> DataFrame:
    """Category an audited fee gives a line: same code, copago closer than ``tolerance``, text that contains the line's first letters.

    fees: account, code, copago, description, category, fee_id. Copagos meet in neighbouring buckets.
    """
    b = F.floor(F.col("copago") / tolerance)
    l = lines.select("account", "line_id", "code", F.col("copago").alias("lc"), F.substring("description", 1, 10).alias("head"), b.alias("b"))
    f = fees.select("account", "code", F.col("copago").alias("fc"), "description", "category", "fee_id", F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    hit = l.join(f, ["account", "code", "b"]).filter((F.abs(F.col("lc") - F.col("fc")) < tolerance) & F.col("description").contains(F.col("head")))
    return hit.groupBy("account", "line_id").agg(F.max_by("category", "fee_id").alias("financial_category"))


def not_flagged(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Lines no finding names by id, label or code: three anti joins instead of one OR."""
    out = lines
    for left, right in (("line_id", "finding_line"), ("description", "label"), ("code", "code")):
        known = findings.select("account", F.col(right).alias(left)).filter(F.col(left).isNotNull()).distinct()
        out = out.join(known, ["account", left], "left_anti")
    return out


def suppress_overlaps(findings: DataFrame, others: DataFrame, tolerance: int = 100) -> DataFrame:
    """Findings without another of the same label and nearly the same amount."""
    b = F.floor(F.col("amount") / tolerance)
    o = others.select("account", "label", F.col("amount").alias("_o"), F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    f = findings.withColumn("_b", b)
    on = (f["account"] == o["account"]) & (f["label"] == o["label"]) & (f["_b"] == o["_b"]) & (F.abs(f["amount"] - o["_o"]) < tolerance)
    return f.join(o, on, "left_anti").drop("_b")


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Finding sources as one table with their precedence."""
    out = None
    for i, (name, df) in enumerate(sources):
        d = df.withColumns({"source": F.lit(name), "precedence": F.lit(i)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


# Words of a line key and the finding words that belong to it.
RELATED = [("material", "material|insumo"), ("medicamento", "medicamento|farmac"), ("honorario", "honorario|medico"), ("sin_bonif", "sin bonif|prestacion.*bonif")]


def findings_of_lines(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings related to lines of the account: by their own key, else by shared words.

    Words meet through the few word classes of a line, not line by finding.
    """
    keyed = findings.filter("line_key is not null").select("account", "finding_id", F.col("line_key").alias("line_id"))
    t, k = F.lower("label"), F.lower("description")
    of = lambda c, side: F.array_compact(F.array(*[F.when(c.rlike(p[side]), F.lit(i)) for i, p in enumerate(RELATED)]))
    loose = findings.filter("line_key is null").select("account", "finding_id", F.explode(of(t, 1)).alias("w"))
    words = lines.select("account", "line_id", F.explode(of(k, 0)).alias("w"))
    return keyed.unionByName(loose.join(words, ["account", "w"]).select("account", "finding_id", "line_id")).distinct()


def freeze(decisions: DataFrame) -> DataFrame:
    """Decisions later stages may not change."""
    return decisions.filter(F.col("source").isin("PRECEDENTE", "DOCTRINA")).select("account", "line_id", F.col("category").alias("frozen"))


def override(later: DataFrame, frozen: DataFrame) -> DataFrame:
    """Later categories, with the frozen ones put back."""
    j = later.join(frozen, ["account", "line_id"], "left")
    return j.withColumn("category", F.coalesce("frozen", "category"))


def trace_generic_charges(items: DataFrame, lines: DataFrame, near_line: int = 1000, near_folio: int = 2000) -> DataFrame:
    """Generic items of 1000 or more: a line's payment within 1000, else a folio's payment within 2000, else unexplained."""
    generic = F.upper("description").rlike("AJUSTE|VARIO|DIFERENCIA|SUMINISTRO|CARGO ADMIN|OTROS|INSUMOS") | F.col("code").rlike(r"^(14|02|99)\d+")
    g = items.filter(generic & (F.col("total") >= 1000)).select("account", "item_id", "total")

    def near(src: DataFrame, key: str, width: int) -> DataFrame:
        b = F.floor(F.col("amount") / width)
        s = src.select("account", key, "amount").select("account", key, "amount", F.explode(F.array(b - 1, b, b + 1)).alias("b"))
        t = g.withColumn("b", F.floor(F.col("total") / width))
        hit = t.join(s, ["account", "b"]).filter(F.abs(F.col("amount") - F.col("total")) <= width)
        return hit.groupBy("account", "item_id").agg(F.min(key).alias(key))

    by_line = near(lines.select("account", "line_id", F.col("bonif").alias("amount")), "line_id", near_line)
    folio = lines.groupBy("account", "folio").agg(F.sum("bonif").alias("amount"))
    by_folio = near(folio, "folio", near_folio)
    j = g.join(by_line, ["account", "item_id"], "left").join(by_folio, ["account", "item_id"], "left")
    kind = first_match([("LINEA", F.col("line_id").isNotNull()), ("FOLIO", F.col("folio").isNotNull())], "SIN_CORRELACION")
    return j.select("account", "item_id", "total", kind.alias("traced"), "line_id", F.when(F.col("line_id").isNull(), F.col("folio")).alias("folio"))


def nutrition_targets(lines: DataFrame) -> DataFrame:
    """Largest charge without payment that may be food: code 3101306 or a text without bonification."""
    hit = F.col("code").contains("3101306") | ((F.col("bonif") == 0) & F.upper("description").contains("SIN BONIFI"))
    amount = F.coalesce(F.nullif("copago", F.lit(0)), F.col("valor"))
    g = lines.filter(hit & (amount > 0)).groupBy("account").agg(F.max(F.struct(amount.alias("valor"), "line_id")).alias("b"))
    return g.select("account", "b.line_id", "b.valor")


def nutrition_match(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Food items that add up to the nutrition charge of the account; a charge without them is one row, not matched."""
    from saldo.functions import lexicon as lx
    from saldo.functions.text import any_of
    from saldo.operators import matching

    food = items.filter(F.upper("description").rlike(any_of(lx.NUTRITION)))
    targets = nutrition_targets(lines)
    hits = matching.subset_match(targets, food, [-F.col("total"), F.col("pos")]).select("account", "line_id", "pos", "total")
    return targets.join(hits, ["account", "line_id"], "left").select("account", "line_id", "valor", "pos", "total", F.col("pos").isNotNull().alias("matched"))


def precedent_stats(precedents: DataFrame) -> DataFrame:
    return precedents.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def learnable(decisions: DataFrame, min_confidence: float = 0.85) -> DataFrame:
    """Confident improper decisions to record as precedents, one per contract and fact."""
    ok = (F.col("category") == "A") & (F.col("confidence") >= min_confidence) & (F.col("source") == "DOCTRINA")
    return decisions.filter(ok).groupBy("contract_hash", "fact_hash").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("lines"))
