"""Totals, control tables and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.money import total
from saldo.functions.rules import first_match
from saldo.operators import classify as K


def input_gates(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Per account: warned lines, difference to the declared copago beyond 500, and the strict verdict."""
    w = lines.withColumn("_w", K.line_warnings(F.col("valor"), F.col("bonif"), F.col("copago")))
    g = w.groupBy("account").agg(F.sum("copago").alias("copago"), F.count_if(F.size("_w") > 0).alias("warned"))
    off = F.abs(F.col("copago") - F.col("declared")) > 500
    return g.join(declared, "account").select("account", "copago", "warned", off.alias("mismatch"), ((F.col("warned") == 0) & ~off).alias("strict_ok"))


def page_totals(items: DataFrame) -> DataFrame:
    """Total and item count per account and page; the row without a page is the document total."""
    per_page = items.filter("page > 0 and total > 0").groupBy("account", "page").agg(
        F.sum("total").alias("t"), F.count(F.lit(1)).alias("n"))
    r = per_page.rollup("account", "page").agg(F.sum("t").alias("total"), F.sum("n").alias("items"))
    return r.filter("account is not null")


def section_totals(items: DataFrame, declared: DataFrame, tax: float = 0.19) -> DataFrame:
    """Declared section totals against the items: error beyond 5, explained by tax within 5 %, otherwise an excess."""
    g = items.groupBy("account", "section").agg(F.sum("total").alias("calculated"))
    d, c = F.col("declared"), F.col("calculated")
    error = F.abs(d - c) > 5
    taxed = F.abs(c * (1 + tax) - d) < d * 0.05
    return g.join(declared, ["account", "section"]).select(
        "account", "section", "calculated", "declared", error.alias("has_error"), (error & taxed).alias("tax_confusion"),
        (error & ~taxed & (d > c)).alias("unjustified"))


def document_balance(items: DataFrame, stated: DataFrame, tolerance: int = 10) -> DataFrame:
    g = items.groupBy("account").agg(F.sum("total").alias("extracted"))
    gap = F.col("extracted") - F.col("stated_total")
    return g.join(stated, "account").select("account", "extracted", "stated_total", gap.alias("discrepancy"), (F.abs(gap) < tolerance).alias("balanced"))


def settlement_totals(lines: DataFrame, declared: DataFrame) -> DataFrame:
    """Totals per folio and, in the row without a folio, per account. Declared totals fall back to the computed ones."""
    g = lines.groupBy("account", "folio").agg(*[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")])
    j = g.join(declared, ["account", "folio"], "left")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"declared_{c}"), F.lit(0)), F.col(c))
    v, b, c = pick("valor"), pick("bonif"), pick("copago")
    v = F.when(((v <= 0) | (v == b)) & (b > 0) & (c > 0), b + c).otherwise(v)
    per = j.select("account", "folio", "valor", "bonif", "copago", v.alias("dv"), b.alias("db"), c.alias("dc"))
    r = per.rollup("account", "folio").agg(*[F.sum(x).alias(x) for x in ("valor", "bonif", "copago", "dv", "db", "dc")]).filter("account is not null")
    gap = F.col("copago") - F.col("dc")
    return r.select("account", "folio", "valor", "bonif", "copago", F.col("dv").alias("declared_valor"), F.col("db").alias("declared_bonif"),
                    F.col("dc").alias("declared_copago"), gap.alias("discrepancy"), (F.abs(gap) <= 500).alias("ok"))


def merge_under_master(lines: DataFrame) -> DataFrame:
    """Totals per master document and provider. The merged documents stay rows: see ``master_members``."""
    m = F.coalesce(F.nullif(F.col("master"), F.lit("")), F.col("folio"))
    return lines.groupBy("account", m.alias("master"), "provider").agg(
        F.count(F.lit(1)).alias("lines"), *[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")])


def master_members(lines: DataFrame) -> DataFrame:
    """Documents merged under each master."""
    m = F.coalesce(F.nullif(F.col("master"), F.lit("")), F.col("folio"))
    return lines.select("account", m.alias("master"), "folio").filter(F.col("folio") != F.col("master")).distinct()


def control_table(lines: DataFrame, findings: DataFrame) -> DataFrame:
    """Copago per group with the state findings give it, and a TOTAL row per account."""
    grouped = lines.withColumn("grp", K.settlement_group(F.col("description"))).groupBy("account", "grp").agg(F.sum("copago").alias("c"))
    total_rows = grouped.rollup("account", "grp").agg(F.sum("c").alias("copago")).filter("account is not null")
    t = F.upper("label")
    targets = F.array_compact(F.array(F.when(t.contains("MATERIALES"), F.lit("MATERIALES")), F.when(t.contains("MEDICAMENTOS"), F.lit("MEDICAMENTOS")),
                                      F.when(t.rlike("SIN BONIFIC|HOTELERIA|ALIMENTACION"), F.lit("SIN BONIFICACION"))))
    hits = findings.select("account", "category", F.explode(targets).alias("grp")).groupBy("account", "grp").agg(
        F.count(F.lit(1)).alias("hits"), *[F.bool_or(F.col("category") == k).alias(k) for k in "AZB"])
    off = F.lit(False)
    state = K.finding_state(*[F.coalesce(F.col(k), off) for k in "AZB"])
    j = total_rows.join(hits, ["account", "grp"], "left").withColumn("s", state)
    whole = F.col("grp").isNull()
    return j.select("account", F.coalesce("grp", F.lit("TOTAL")).alias("grp"), "copago", F.when(whole, "-").otherwise(F.col("s.state")).alias("state"),
                    F.when(whole, "-").otherwise(F.col("s.action")).alias("action"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def category_sums(findings: DataFrame) -> DataFrame:
    """Amounts per account and category A, B, K, Z."""
    return findings.groupBy("account").agg(*[total(F.when(F.col("category") == k, F.col("amount"))).alias(k) for k in "ABKZ"])


def reconciliation(sums: DataFrame) -> DataFrame:
    """Rows A, B, OK, Z and TOTAL per account from columns A, B, Z and copago."""
    ok = F.greatest(F.lit(0), F.col("copago") - F.col("A") - F.col("B") - F.col("Z"))
    s = sums.withColumn("OK", ok)
    shown = F.when(F.col("copago") > 0, F.col("copago")).otherwise(F.col("A") + F.col("B") + F.col("OK") + F.col("Z"))
    rows = F.array(*[F.struct(F.lit(n).alias("category"), v.alias("amount")) for n, v in
                     [("A", F.col("A")), ("B", F.col("B")), ("OK", F.col("OK")), ("Z", F.col("Z")), ("TOTAL", shown)]])
    return s.select("account", F.explode(rows).alias("r")).select("account", "r.*")


def composition(items: DataFrame, bucket: Column) -> DataFrame:
    """Count and amount per bucket with a TOTAL row."""
    g = items.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("t"))
    return g.rollup("bucket").agg(F.sum("n").alias("items"), F.sum("t").alias("amount")).withColumn("bucket", F.coalesce("bucket", F.lit("TOTAL")))


def is_material(section: Column, description: Column) -> Column:
    s, d = F.upper(section), F.upper(description)
    return s.rlike("MATERIALES|FARMACIA|INSUM") | d.contains("MATERIAL")


def is_hotel(section: Column, description: Column) -> Column:
    return F.upper(section).contains("ALIMENTACION") | F.upper(description).rlike("ALMUERZO|KIT INGRESO|TERMOMETRO|PAÑO")


def audit_summary(audited: DataFrame) -> DataFrame:
    """Per account over audited lines (copago, level, motor, excess, opacity score and flag)."""
    c = F.col
    finding = (c("level") != "CORRECTO") | c("opaque")
    of = lambda m: finding & (c("motor") == m)
    g = audited.groupBy("account").agg(
        F.sum("copago").alias("copago"), total(F.when(finding, c("copago"))).alias("impact"), F.count_if(of("M1")).alias("m1"),
        F.count_if(of("M2")).alias("m2"), total(F.when(of("M3"), c("copago"))).alias("m3_copago"), F.count_if(of("M5")).alias("m5"),
        total(F.when(of("M5"), c("excess"))).alias("m5_excess"), F.max("score").alias("max_score"))
    share = F.when(c("copago") > 0, c("m3_copago") / c("copago")).otherwise(F.lit(0.0))
    systemic = (c("m1") >= 3) | (c("m2") >= 5) | (c("m5") >= 3) | (share >= lx.SYSTEMIC_SHARE)
    return g.select("*", share.alias("m3_share"), systemic.alias("systemic"))


def finding_matrix(audited: DataFrame) -> DataFrame:
    """Flagged lines only."""
    return audited.filter((F.col("level") != "CORRECTO") | F.col("opaque")).select("account", "line_id", "level", "motor", "copago", "score")


def quality_gates(items: DataFrame, target: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Seven gates per account: strictness, exact reconciliation, arithmetic and coverage of code, date, quantity, price."""
    c = F.col
    expected = F.floor(c("qty") * c("unit_price") + 0.5)
    wrong = (c("qty") > 0) & (c("unit_price") > 0) & (c("total") > 0) & (F.abs(expected - c("total")) > F.greatest(F.lit(100), expected * 0.2))
    g = items.groupBy("account").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total").alias("extracted"), F.count_if(wrong).alias("math_mismatch"),
        F.count_if(F.coalesce(F.trim("code"), F.lit("")) != "").alias("coded"), F.count_if(c("ts").isNotNull()).alias("dated"),
        F.count_if(c("qty") > 0).alias("counted"), F.count_if(c("unit_price") > 0).alias("priced"))
    j = g.join(target, "account")
    full = lambda k: c(k) / c("n") >= threshold
    gates = {"strict_quality": c("strict"), "reconciliation_exact": F.abs(c("extracted") - c("target")) <= 1, "math_consistency": c("math_mismatch") == 0,
             "code_coverage": full("coded"), "date_coverage": full("dated"), "quantity_coverage": full("counted"), "unit_price_coverage": full("priced")}
    every = None
    for p in gates.values():
        every = p if every is None else every & p
    word = lambda p: F.when(p, "PASS").otherwise("FAIL")
    return j.select("account", "n", "math_mismatch", *[word(p).alias(k) for k, p in gates.items()], word(every).alias("overall"))


def declared_target(totals: DataFrame) -> DataFrame:
    """Target total by precedence (bill, clinic, subtotals) and the status of the extracted sum against it."""
    c = F.col
    source = first_match([("billDeclaredTotal", c("bill_declared") > 0), ("clinicTotalGeneral", c("clinic_declared") > 0),
                          ("subtotalIsapreSum", c("subtotals") > 0)], "unknown")
    target = first_match([(c("bill_declared"), c("bill_declared") > 0), (c("clinic_declared"), c("clinic_declared") > 0)], c("subtotals"))
    cover = F.when(target > 0, c("extracted") / target)
    status = first_match([("NO_TARGET", target <= 0), ("OK", F.abs(c("extracted") - target) <= 1), ("OVER", cover > 1.2), ("UNDER", cover < 0.8)], "GAP")
    return totals.select("account", source.alias("source"), target.alias("target"), "extracted", status.alias("status"))


def dead_pages(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pages that print rows but gave no item."""
    return rows.select("account", "page").distinct().join(items.select("account", "page").distinct(), ["account", "page"], "left_anti")


METRICS = ["item_total", "gross", "insurer", "patient", "taxed", "exempt_and_taxed"]


def subtotal_blocks(items: DataFrame, subtotals: DataFrame) -> DataFrame:
    """Pages between printed subtotals: six sums against the subtotal and the name of the closest."""
    from saldo.operators import sequence

    per_page = items.groupBy("account", "page").agg(*[F.sum(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))
    marks = subtotals.select("account", "page", F.col("amount").alias("target"))
    both = per_page.join(marks, ["account", "page"], "full")
    block = sequence.carry(both, ["account"], ["page"], sequence.by_pos("page"), nexts={"end_page": F.when(F.col("target").isNotNull(), F.col("page"))})
    g = block.filter("end_page is not null").groupBy("account", "end_page").agg(
        F.min("page").alias("start_page"), F.max("target").alias("target"), total(F.col("n")).alias("items"), *[total(F.col(m)).alias(m) for m in METRICS])
    gaps = F.array(*[F.struct(F.abs(F.col(m) - F.col("target")).alias("gap"), F.lit(i).alias("i"), F.lit(m).alias("name")) for i, m in enumerate(METRICS)])
    return g.select("account", "start_page", "end_page", "target", "items", F.array_min(gaps)["gap"].alias("gap"), F.array_min(gaps)["name"].alias("closest"))


def provider_summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("account", "folio", "provider").agg(F.count(F.lit(1)).alias("items"))


def principal_provider(lines: DataFrame, header: Column) -> DataFrame:
    """The header's provider, else the one with the largest total (the smaller id on ties)."""
    g = lines.groupBy("account", "provider").agg(F.sum("valor").alias("v"), F.max(header).alias("h"))
    p = g.groupBy("account").agg(F.max("h").alias("h"), F.max_by("provider", F.struct("v", -F.col("provider"))).alias("p"))
    return p.select("account", F.coalesce(F.col("h"), F.col("p").cast("string")).alias("principal"))


def literal_totals(folios: DataFrame) -> DataFrame:
    """Declared totals of the documents whose source text prints a TOTAL line."""
    lit = folios.filter(F.upper("source_text").rlike(r"\bTOTAL(ES)?\b"))
    return lit.groupBy("account").agg(*[F.sum(c).alias(c) for c in ("valor", "bonif", "copago")], F.count_distinct("source_text").alias("sources"))


def event_integrity(episodes: DataFrame, declared: DataFrame) -> DataFrame:
    """Accounts with a declared copago whose episodes add up to nothing: the audit must stop there."""
    g = episodes.groupBy("account").agg(F.sum("copago").alias("events"))
    return declared.join(g, "account", "left").filter((F.col("declared") > 0) & (F.coalesce("events", F.lit(0)) == 0)).select("account", "declared")


def require_integrity(df: DataFrame) -> DataFrame:
    """Fail the job when a row with a declared copago has no events."""
    bad = (F.col("declared") > 0) & (F.coalesce("events", F.lit(0)) == 0)
    return df.withColumn("events", F.when(bad, F.raise_error(F.lit("events add up to zero under a declared copago"))).otherwise(F.col("events")))
