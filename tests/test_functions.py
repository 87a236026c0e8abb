"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from saldo.functions import caps, ids, lexicon, money, rules, text
from saldo.operators import classify as K


def value(spark, column, **inputs):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    out = row.select(column.alias("v")).first()["v"]
    return out.asDict() if hasattr(out, "asDict") else out


@pytest.mark.parametrize("raw,amount", [("1.234,56", 1234.56), ("267.808", 267808.0), ("3.5", 3.5), ("(1.000)", -1000.0), ("1,234.56", 1234.56), ("-5", -5.0), ("", 0.0), ("-", 0.0), ("8,764", 8764.0), ("1.234.567", 1234567.0)])
def test_mixed_money(spark, raw, amount):
    assert value(spark, money.parse_mixed(F.col("x")), x=raw) == amount


@pytest.mark.parametrize("raw,amount", [("1,000", 1.0), ("2.500", 2.5), ("12", 12.0)])
def test_quantity(spark, raw, amount):
    assert value(spark, money.parse_mixed(F.col("x"), quantity=True), x=raw) == amount


@pytest.mark.parametrize("x,r", [(-2.5, -2), (2.5, 3), (-2.51, -3), (0.49, 0)])
def test_round_is_floor_of_half(spark, x, r):
    assert value(spark, money.round_half_up(F.col("x")), x=x) == r


@pytest.mark.parametrize("cell,kind,unit,amount,reason", [
    ("", "NO_ENCONTRADO", None, None, "CELDA_VACIA_OCR"), ("SIN TOPE", "SIN_TOPE_EXPLICITO", None, None, "SIN_TOPE_EXPRESO_EN_CONTRATO"),
    ("2,2 V.A", "NUMERICO", "VA", 2.2, None), ("60 UF", "NUMERICO", "UF", 60.0, None), ("5", "NUMERICO", None, 5.0, "UNIDAD_NO_DETECTADA"),
    ("ilimitado", "SIN_TOPE_EXPLICITO", None, None, "SIN_TOPE_EXPRESO_EN_CONTRATO"), ("abc", "NO_ENCONTRADO", None, None, "FORMATO_NO_RECONOCIDO")])
def test_strict_cap(spark, cell, kind, unit, amount, reason):
    assert value(spark, caps.strict_cap(F.col("x")), x=cell) == {"kind": kind, "unit": unit, "value": amount, "reason": reason}


@pytest.mark.parametrize("cell,factor,unit", [("1,2 veces AC2", 1.2, "AC2"), ("120% ARANCEL", 1.2, "AC2"), ("$ 5000", 5000.0, "PESOS"), ("10 UF", 0.0, "UNKNOWN"), ("1.5 x VAM", 1.5, "VAM"), ("-", 0.0, "UNKNOWN")])
def test_ceiling(spark, cell, factor, unit):
    assert value(spark, caps.ceiling_factor(F.col("x")), x=cell) == {"factor": factor, "unit": unit}


@pytest.mark.parametrize("q,u,t,model", [(2.0, 9805, 850, "UNIT_PRICE_UNTRUSTED"), (0.03, 15_000_000, 468_000, "PRORATED_REFERENCE_PRICE"), (1.0, 100, 100, "MULTIPLICATIVE_EXACT")])
def test_billing_models(spark, q, u, t, model):
    assert value(spark, K.billing_model(F.col("q"), F.col("u"), F.col("t"))["model"], q=q, u=u, t=t) == model


def test_text(spark):
    assert value(spark, text.normalize_strict(F.col("x")), x=" Día-Cama, Ñandú! ") == "diacama nandu"
    assert value(spark, text.normalize_spaced(F.col("x")), x="Día-Cama, Ñandú!") == "DIA CAMA NANDU"
    assert value(spark, text.repair_mojibake(F.col("x")), x="PabellÃ³n") == "Pabellón"
    assert value(spark, text.exception_providers(F.col("x")), x="90% salvo 70% en Clinica Alfa, Centro Beta") == ["Clinica Alfa", "Centro Beta"]
    assert value(spark, text.has_term(F.col("x"), "rm"), x="informe normal") is False
    assert value(spark, money.format_money(F.col("x")), x=-1234567) == "-$1.234.567"


def test_gloss_and_domain(spark):
    g = K.gloss_type(F.col("c"), F.col("d"), F.col("v"), F.col("p"))
    assert value(spark, g, c="3201001", d="GASTOS NO CUBIERTOS", v=100, p=100) == "TGE_A"
    assert value(spark, g, c="9", d="no arancelado", v=100, p=10) == "TGE_B"
    dom = K.contract_domain(F.col("c"), F.col("d"))
    assert value(spark, dom, c="1101001", d="Anestesia") == "PABELLON"
    assert value(spark, dom, c="0601001", d="x") == "KINESIOLOGIA"
    assert value(spark, dom, c="x", d="Traslado en ambulancia") == "TRASLADOS"


def test_promotion_gate(spark):
    p = K.can_promote(F.col("n"), F.col("m"), F.col("c"), F.col("j"))
    assert value(spark, p, n=2, m=False, c=True, j=False) is False
    assert value(spark, p, n=2, m=False, c=False, j=True) is True
    assert value(spark, p, n=2, m=True, c=True, j=False) is True
    assert value(spark, p, n=1, m=True, c=True, j=True) is False


def test_rule_sets(spark):
    rs = [rules.Rule("R1", F.lit(True), "HIGH", "a"), rules.Rule("R2", F.lit(False), "LOW", "b"), rules.Rule("R3", F.lit(None).cast("boolean"), "LOW", "c")]
    assert [r["rule_id"] for r in value(spark, rules.all_matches(rs))] == ["R1"]
    assert value(spark, ids.stable_id(F.lit("a b"), F.lit("c"))) == "a_b|c"
    assert len(lexicon.DRUG_NAME) == len(set(lexicon.DRUG_NAME))
