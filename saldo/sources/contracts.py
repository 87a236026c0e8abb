"""Contracts in four dialects to one rule table, and folders of contract packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.functions.caps import percent_cell, strict_cap
from saldo.functions.rules import first_match, lookup
from saldo.sources.bills import _S, _struct

MODALITY = _struct(tipo=_S, porcentaje=_S, tope=_S)
COVERAGE = _struct(categoria=_S, item=_S, descripcion_textual=_S, porcentaje=_S, tipo_modalidad=_S, tope=_S, modalidades=T.ArrayType(MODALITY))
RULE = _struct(domain=_S, modalidad=_S, coberturaPct=_S, tope=_S, textLiteral=_S)
ATOM = _struct(value=_S, unit=_S)
ASSIGNMENT = _struct(assignment_id=_S, row_id=_S, column_id=_S, atoms=T.ArrayType(ATOM))
CONTRACT = _struct(contract_id=_S, coberturas=T.ArrayType(COVERAGE), rules=T.ArrayType(RULE), assignments=T.ArrayType(ASSIGNMENT))


def read_contracts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(CONTRACT).json(path, multiLine=multi_line, mode="PERMISSIVE")


def read_packages(spark: SparkSession, glob: str, prefix: str = "audit_package_", suffix: str = r"_v[\d.]+\.json") -> DataFrame:
    """Packages of a folder, one row each, named by their file."""
    raw = spark.read.schema(CONTRACT).json(glob, multiLine=True, mode="PERMISSIVE")
    name = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), f"^{prefix}", ""), suffix, "")
    return raw.withColumn("contract_id", F.regexp_replace(name, "%20", " "))


def read_package_folders(spark: SparkSession, glob: str, key: str = "contract_id") -> DataFrame:
    """Packages as lines of JSON in one folder a contract, named by the folder of their file."""
    schema = T.StructType([f for f in CONTRACT.fields if f.name != key])
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"))
    name = F.url_decode(F.regexp_extract("path", f"/{key}=([^/]*)/", 1))
    return lines.select(name.alias(key), F.from_json("value", schema).alias("p")).select(key, "p.*")


def dialect(raw: DataFrame) -> DataFrame:
    """Which keys a contract document has decides its dialect."""
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) > 0
    nested = F.exists(F.coalesce("coberturas", F.array().cast(T.ArrayType(COVERAGE))), lambda c: F.coalesce(F.size(c["modalidades"]), F.lit(0)) > 0)
    return raw.withColumn("dialect", first_match([("ENGINE", n("rules")), ("HIGH_FIDELITY", n("coberturas") & nested), ("CANONICAL", n("coberturas")), ("PACKAGE", n("assignments"))], "EMPTY"))


def contract_rules(raw: DataFrame) -> DataFrame:
    """Rules of every dialect: contract_id, dialect, pos, benefit, modality, pct, cap_kind, cap_unit, cap_value."""
    d = dialect(raw)
    cap = lambda c: strict_cap(c)
    pct = percent_cell
    low = lambda c: F.lower(c)

    def adapt(df: DataFrame, benefit, modality, percent, tope) -> DataFrame:
        c = cap(tope)
        return df.select("contract_id", "dialect", "pos", benefit.alias("benefit"), low(modality).alias("modality"), pct(percent).alias("pct"), c["kind"].alias("cap_kind"), c["unit"].alias("cap_unit"), c["value"].alias("cap_value"))

    at = lambda name, col: d.filter(F.col("dialect") == name).select("contract_id", "dialect", F.posexplode(col).alias("pos", "r"))
    engine = adapt(at("ENGINE", "rules"), F.col("r.domain"), F.col("r.modalidad"), F.col("r.coberturaPct"), F.col("r.tope"))
    flat = adapt(at("CANONICAL", "coberturas"), F.coalesce("r.item", "r.descripcion_textual"), F.col("r.tipo_modalidad"), F.col("r.porcentaje"), F.col("r.tope"))
    nested = at("HIGH_FIDELITY", "coberturas").select("contract_id", "dialect", "pos", F.col("r.item").alias("item"), F.explode("r.modalidades").alias("m"))
    high = adapt(nested, F.col("item"), F.col("m.tipo"), F.col("m.porcentaje"), F.col("m.tope"))
    pk = at("PACKAGE", "assignments").withColumn("a", F.try_element_at("r.atoms", F.lit(1)))
    is_pct = F.col("a.unit") == "%"
    side = first_match([("preferente", F.col("r.column_id").contains("PREF")), ("libre_eleccion", F.col("r.column_id").rlike("LE_|LIBRE"))], "desconocido")
    label = F.translate(F.regexp_replace("r.row_id", "^R_", ""), "_", " ")
    package = adapt(pk, label, side, F.when(is_pct, F.concat("a.value", F.lit("%"))), F.when(~is_pct, F.concat_ws(" ", "a.value", "a.unit")))
    return engine.unionByName(flat).unionByName(high).unionByName(package)
