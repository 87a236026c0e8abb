"""Reading the star-schema tables as bills, settlements and contracts.

A bill account is an order, a bill item is a line of it, a settlement line is a group of items the
insurer paid together. Prices become whole currency units (two decimals shifted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.rules import lookup
from saldo.operators import sequence

# How words of the part tables read as bill vocabulary.
GLOSS = {"ring": "JERINGA 5 ML", "bolt": "PARACETAMOL 500 MG", "plate": "DIA CAMA MEDICINA", "rod": "TROCAR LAPAROSCOPICO",
         "gear": "DERECHO DE PABELLON", "gizmo": "SUTURA VICRYL", "anvil": "SET DE ASEO PERSONAL", "widget": "HONORARIO CIRUJANO"}
QUALIFIER = {"hot": "INYECTABLE", "old": "ALMUERZO REGIMEN", "blue": "NO CUBIERTO", "new": "CONTROL ENFERMERIA",
             "cold": "VISITA MEDICA", "red": "TOALLA", "large": "INSUMOS VARIOS", "small": "MEDICIÓN"}
SECTION = {"STANDARD": "PABELLON", "PROMO": "FARMACIA", "SMALL": "", "MEDIUM": "INSUMOS CLINICOS", "ECONOMY": "HOSPITALIZACION",
           "LARGE": "URGENCIA"}
LINE_CODE = {"AF": "3101001", "AO": "3101002", "RF": "3201001", "RO": "3201002", "NF": "1103057", "NO": "0303001"}
LINE_TEXT = {"AF": "MEDICAMENTOS CLINICOS EN HOSPITALIZACION", "AO": "MATERIALES CLINICOS QUIRURGICOS",
             "RF": "GASTOS NO CUBIERTOS POR EL PLAN", "RO": "PRESTACION NO CONTEMPLADA EN EL ARANCEL",
             "NF": "HONORARIO MEDICO CIRUJANO", "NO": "EXAMEN DE LABORATORIO URGENCIA"}
DOMAINS = ["MEDICAMENTOS_HOSP", "MATERIALES_CLINICOS", "OTROS", "HONORARIOS", "EXAMENES", "HOSPITALIZACION", "PABELLON"]
CAP_KINDS = ["UF", "SIN_TOPE_EXPRESO", "CLP", "VAM", "VARIABLE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Price with two decimals as whole units."""
    return F.round(F.col(c) * 100 if isinstance(c, str) else c * 100).cast("long")


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill items without descriptions and positions: one scan, no shuffle."""
    li = table(spark, sf_dir, "lineitem")
    total = money("l_extendedprice")
    share = F.round(F.col("l_discount") * 100).cast("long")
    rejected = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_orderkey").alias("account"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("provider"), F.col("l_quantity").alias("qty"), total.alias("total"),
        F.when(rejected, total).otherwise(F.expr("cast(round(l_extendedprice * 100) as long) * cast(round(l_discount * 100) as long) div 100"))
        .alias("copago"),
        F.concat("l_returnflag", "l_linestatus").alias("folio"), F.col("l_shipdate").alias("ts"),
    ).withColumn("bonif", F.col("total") - F.col("copago"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item dictionary: description, section, code, reference price."""
    p = table(spark, sf_dir, "part")
    noun, adj = F.split("p_name", " ").getItem(1), F.split("p_name", " ").getItem(0)
    brand = F.regexp_extract("p_brand", r"#(\d+)", 1)
    return p.select(
        F.col("p_partkey").alias("part"),
        F.concat(lookup(noun, GLOSS), F.lit(" "), lookup(adj, QUALIFIER)).alias("description"),
        lookup(F.col("p_type"), SECTION).alias("section"),
        F.concat(F.lpad(brand, 2, "0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("001")).alias("code"),
        money("p_retailprice").alias("unit_price"), F.col("p_size").alias("size"), "p_type", "p_name",
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bill items with descriptions. Spark picks the join from the sizes it knows."""
    return charges(spark, sf_dir).join(parts(spark, sf_dir), "part")


def numbered(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Items with their position in the account. Chunked by page and part so that no account is one task; ``counted`` as in ``sequence.carry``."""
    out = sequence.number(df, ["account"], ["page", "part", "provider", "total", "qty", "folio", "ts"],
                          F.struct("page", F.floor(F.col("part") / 4096)), counted=counted)
    return out.withColumn("item_id", F.concat(F.lit("B_"), F.lpad(F.col("pos").cast("string"), 5, "0")))


def bill_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, pos, item_id, page, part, provider, qty, total, copago, bonif, folio, ts + description, section, code, unit_price."""
    # Charges are counted before they meet their parts: only the size of the largest accounts matters.
    return numbered(described(spark, sf_dir), charges(spark, sf_dir).select("account"))


def settlement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, line_id, folio, code, description, valor, bonif, copago, items, provider, ts."""
    g = charges(spark, sf_dir).groupBy("account", "folio").agg(
        F.sum("total").alias("valor"), F.sum("bonif").alias("bonif"), F.sum("copago").alias("copago"),
        F.count(F.lit(1)).alias("items"), F.min("provider").alias("provider"), F.min("ts").alias("ts"))
    return g.withColumns({
        "line_id": F.concat_ws(":", F.col("account").cast("string"), F.col("folio")),
        "code": lookup(F.col("folio"), LINE_CODE),
        "description": lookup(F.col("folio"), LINE_TEXT),
    })


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, contract_id, stated_total, ts, priority."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    who = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "r_name")
    return o.join(who, o.o_custkey == who.c_custkey).select(
        F.col("o_orderkey").alias("account"), F.col("r_name").alias("contract_id"), money("o_totalprice").alias("stated_total"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("priority"))


def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per nation and domain: contract_id, rule_id, pos, domain, modality, pct, cap_kind, cap_value, clinic, text."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    base = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("r_name").alias("contract_id"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("clinic"))
    dom = base.select("*", F.posexplode(F.array(*[F.lit(d) for d in DOMAINS[:-1]])).alias("d", "domain"))
    pos = F.col("k") * 10 + F.col("d")
    kinds = F.array(*[F.lit(k) for k in CAP_KINDS])
    kind = F.element_at(kinds, (F.pmod(pos, F.lit(5)) + 1).cast("int"))
    pct = F.when(F.pmod(pos, F.lit(11)) == 0, F.lit(None)).otherwise(50 + F.pmod(pos * 7, F.lit(51))).cast("double")
    modality = F.when(F.pmod(pos, F.lit(2)) == 0, "preferente").otherwise("libre_eleccion")
    return dom.select(
        "contract_id", F.concat(F.lit("R"), pos.cast("string")).alias("rule_id"), pos.alias("pos"), "domain",
        modality.alias("modality"), pct.alias("pct"), kind.alias("cap_kind"),
        F.when(kind.isin("SIN_TOPE_EXPRESO"), F.lit(None)).otherwise(F.pmod(pos, F.lit(90)) + 1).cast("double").alias("cap_value"),
        "clinic", F.concat_ws(" ", F.col("domain"), modality, F.col("clinic")).alias("text"))


def bill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed rows: one per item and a footer per settled folio. account, page, row_no, kind, text."""
    dotted = lambda c: F.translate(F.format_number(F.col(c), 0), ",", ".")
    d = described(spark, sf_dir)
    item_rows = d.select(
        "account", "page", (F.col("part") * 1000 + F.col("provider")).alias("row_no"),
        F.when(F.col("folio").startswith("N"), "item_secondary").otherwise("item_primary").alias("kind"),
        F.concat_ws(" ", "description", F.col("qty").cast("int").cast("string"), dotted("total"), dotted("copago")).alias("text"))
    feet = settlement_lines(spark, sf_dir).filter(F.col("folio").endswith("F")).select(
        "account", F.lit(8).alias("page"), F.col("provider").alias("row_no"), F.lit("footer").alias("kind"),
        F.concat_ws(" ", F.lit("TOTAL EMPRESA"), dotted("valor"), dotted("bonif")).alias("text"))
    return item_rows.unionByName(feet)
