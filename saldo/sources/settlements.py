"""Settlements: folios, providers and items to flat lines and declared totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.functions.money import parse_date, parse_whole
from saldo.sources.bills import _S, _struct

LINE = _struct(codigo_prestacion=_S, codigo_fonasa=_S, codigoGC=_S, codigo=_S, gc=_S, descripcion=_S, glosa=_S, cantidad=_S, valorTotal=_S, bonificacion=_S, copago=_S, fecha=_S)
PROVIDER = _struct(nombrePrestador=_S, items=T.ArrayType(LINE))
SUMMARY = _struct(totalValorDeclarado=_S, totalBonificacionDeclarada=_S, totalCopagoDeclarado=_S, fuenteTotalDeclarado=_S)
FOLIO = _struct(folioPAM=_S, folio=_S, masterPamFolio=_S, prestadorPrincipal=_S, fechaEmision=_S, items=T.ArrayType(LINE), desglosePorPrestador=T.ArrayType(PROVIDER), resumen=SUMMARY)
SETTLEMENT = _struct(account_id=_S, folios=T.ArrayType(FOLIO))
PLACES = T.ArrayType(T.StructType([T.StructField("provider_no", T.IntegerType()), T.StructField("provider", _S), T.StructField("items", T.ArrayType(LINE))]))


def read_settlements(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    schema = T.StructType([*SETTLEMENT.fields, T.StructField("_corrupt_record", _S)])
    return spark.read.schema(schema).json(path, multiLine=multi_line, mode="PERMISSIVE")


def flatten_settlement(raw: DataFrame) -> DataFrame:
    """Lines under providers and directly under folios. Codes and texts take the first alias present."""
    f = raw.select("account_id", F.posexplode("folios").alias("folio_no", "f"))
    # Both places in one pass over the documents: lines directly under the folio are a provider of their own, numbered -1.
    place = lambda no, who, items: F.struct(no.alias("provider_no"), who.alias("provider"), items.alias("items"))
    direct = F.array(place(F.lit(-1), F.col("f.prestadorPrincipal"), F.col("f.items")))
    under = F.transform("f.desglosePorPrestador", lambda p, no: place(no, p["nombrePrestador"], p["items"]))
    e = f.select("account_id", "folio_no", "f", F.explode(F.concat(direct, F.coalesce(under, F.array().cast(PLACES)))).alias("g")).select(
        "account_id", "folio_no", "f", "g.provider_no", "g.provider", F.posexplode("g.items").alias("item_no", "i"))
    i = lambda n: F.col(f"i.{n}")
    folio = F.coalesce("f.folioPAM", "f.folio")
    return e.select(
        "account_id", folio.alias("folio"), F.nullif("f.masterPamFolio", F.lit("")).alias("master"), F.coalesce("provider", "f.prestadorPrincipal").alias("provider"),
        F.concat_ws("-", "account_id", "folio_no", "provider_no", "item_no").alias("line_id"), "folio_no", "provider_no", "item_no",
        F.coalesce(i("codigo_prestacion"), i("codigo_fonasa"), i("codigoGC"), i("codigo"), i("gc"), F.lit("")).alias("code"), F.coalesce(i("descripcion"), i("glosa"), F.lit("")).alias("description"),
        i("cantidad").alias("qty"), parse_whole(i("valorTotal")).alias("valor"), parse_whole(i("bonificacion")).alias("bonif"), parse_whole(i("copago")).alias("copago"),
        parse_date(F.coalesce(i("fecha"), F.col("f.fechaEmision"))).alias("ts"))


def declared_totals(raw: DataFrame) -> DataFrame:
    f = raw.select("account_id", F.explode("folios").alias("f"))
    r = lambda n: parse_whole(F.col(f"f.resumen.{n}"))
    return f.select("account_id", F.coalesce("f.folioPAM", "f.folio").alias("folio"), r("totalValorDeclarado").alias("declared_valor"), r("totalBonificacionDeclarada").alias("declared_bonif"),
                    r("totalCopagoDeclarado").alias("declared_copago"), F.col("f.resumen.fuenteTotalDeclarado").alias("source_text"))


DUPLICATE_KEY = ["account_id", "folio", "provider", "code", "description", "qty", "valor", "bonif", "copago"]


def drop_duplicates(lines: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Exact repetitions of a line, first one kept by its id."""
    k = key or DUPLICATE_KEY
    rest = [c for c in lines.columns if c not in k]
    first = lines.groupBy(*k).agg(F.min(F.struct("line_id", *[c for c in rest if c != "line_id"])).alias("_f"))
    return first.select(*k, *[F.col(f"_f.{c}").alias(c) for c in rest])


def keep_longest_text(items: DataFrame, key: list[str], text: str, pos: str) -> DataFrame:
    """One row per key: the longest text, the first one on equal length."""
    rest = [c for c in items.columns if c not in key]
    best = items.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(-F.length(text), pos)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])
