"""Bills: nested JSON in several wrappings to flat items, and exported page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.functions.money import parse_mixed, round_half_up

_S = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Numbers are read as text: sources write them with either separator.
ITEM = _struct(index=_S, page=_S, code=_S, codigo=_S, description=_S, descripcion=_S, rawText=_S, quantity=_S, qty=_S, unitPrice=_S, total=_S, copago=_S)
SECTION = _struct(category=_S, sectionTotal=_S, items=T.ArrayType(ITEM))
BODY = _struct(items=T.ArrayType(ITEM), rows=T.ArrayType(ITEM), sections=T.ArrayType(SECTION))
ROW = _struct(page=_S, text=_S, rowKind=_S)
BILL = T.StructType([T.StructField("account_id", _S), T.StructField("content", _S), T.StructField("data", BODY), *BODY.fields])
PAGES = _struct(account_id=_S, pages=T.MapType(_S, _struct(rows=T.ArrayType(ROW))))


def read_bills(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw bills under a declared schema; fields a file lacks are null, broken documents land in _corrupt_record."""
    schema = T.StructType([*BILL.fields, T.StructField("_corrupt_record", _S)])
    return spark.read.schema(schema).json(path, multiLine=multi_line, mode="PERMISSIVE")


def flatten_bill(raw: DataFrame) -> DataFrame:
    """Items of bills wrapped as content text, data, items, rows or sections: account_id, pos, page, section, code, description, qty, unit_price, total, copago."""
    body = F.coalesce(F.from_json("content", BODY), F.col("data"), F.struct("items", "rows", "sections"))
    b = raw.select("account_id", body.alias("b"))
    loose = F.transform(F.coalesce("b.items", "b.rows", F.array().cast(T.ArrayType(ITEM))), lambda i: F.struct(F.lit("").alias("section"), i.alias("i")))
    grouped = F.flatten(F.transform(F.coalesce("b.sections", F.array().cast(T.ArrayType(SECTION))), lambda s: F.transform(
        F.coalesce(s["items"], F.array().cast(T.ArrayType(ITEM))), lambda i: F.struct(F.coalesce(s["category"], F.lit("")).alias("section"), i.alias("i")))))
    e = b.select("account_id", F.posexplode(F.concat(loose, grouped)).alias("at", "x"))
    i = lambda n: F.col(f"x.i.{n}")
    money = lambda c: round_half_up(parse_mixed(c))
    qty = F.coalesce(i("quantity"), i("qty"))
    return e.select(
        "account_id", F.coalesce(i("index").try_cast("long"), F.col("at").cast("long")).alias("pos"), i("page").try_cast("int").alias("page"), F.col("x.section").alias("section"),
        F.coalesce(i("code"), i("codigo")).alias("code"), F.coalesce(i("description"), i("descripcion"), i("rawText")).alias("description"),
        F.when(qty.isNotNull(), parse_mixed(qty, quantity=True)).alias("qty"), money(i("unitPrice")).alias("unit_price"), money(i("total")).alias("total"),
        F.when(i("copago").isNotNull(), money(i("copago"))).alias("copago"))


def page_rows(raw: DataFrame) -> DataFrame:
    """Rows of an export that maps page numbers to rows."""
    p = raw.select("account_id", F.explode("pages").alias("key", "p"))
    r = p.select("account_id", "key", F.posexplode("p.rows").alias("row_no", "r"))
    return r.select("account_id", F.coalesce(F.col("r.page").try_cast("int"), F.col("key").try_cast("int"), F.lit(0)).alias("page"), "row_no",
                    F.coalesce("r.rowKind", F.lit("unknown")).alias("kind"), F.col("r.text").alias("text"))
