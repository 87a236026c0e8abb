"""Nested documents, dialects, keyed stores and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, RULES
from saldo.catalog.registry import query
from saldo.sources import bills, contracts, settlements, star, stores
from saldo.streaming import sessions


@query("s01_bill_wrappings", f"WITH {DESCRIBED} SELECT CAST(account AS VARCHAR) AS account_id, page, CASE WHEN page % 5 = 4 THEN section ELSE '' END AS section, code, description, qty, total FROM described")
def s01(spark, sf):
    d = star.described(spark, sf)
    s = lambda c: F.col(c).cast("string")
    it = F.array(F.struct(s("page").alias("page"), "code", "description", F.col("qty").cast("int").cast("string").alias("quantity"), s("total").alias("total")))
    k = F.col("page") % 5
    acc = s("account").alias("account_id")
    doc = (F.when(k == 0, F.to_json(F.struct(acc, F.to_json(F.struct(it.alias("items"))).alias("content")))).when(k == 1, F.to_json(F.struct(acc, F.struct(it.alias("items")).alias("data"))))
           .when(k == 2, F.to_json(F.struct(acc, it.alias("items")))).when(k == 3, F.to_json(F.struct(acc, it.alias("rows"))))
           .otherwise(F.to_json(F.struct(acc, F.array(F.struct(F.col("section").alias("category"), it.alias("items"))).alias("sections")))))
    raw = d.select(F.from_json(doc, bills.BILL).alias("b")).select("b.*")
    return bills.flatten_bill(raw).select("account_id", "page", "section", "code", "description", "qty", "total")


@query("s09_page_rows", f"WITH {DESCRIBED} SELECT CAST(account AS VARCHAR) AS account_id, CAST(page AS INT) AS page, 'unknown' AS kind, description AS text FROM described")
def s09(spark, sf):
    d = star.described(spark, sf)
    doc = F.concat(F.lit('{"account_id":"'), F.col("account").cast("string"), F.lit('","pages":{"'), F.col("page").cast("string"), F.lit('":{"rows":[{"text":"'), "description", F.lit('"}]}}}'))
    return bills.page_rows(d.select(F.from_json(doc, bills.PAGES).alias("p")).select("p.*")).select("account_id", "page", "kind", "text")


def raw_settlements(spark, sf):
    c = star.charges(spark, sf)
    s = lambda x: F.col(x).cast("string")
    dotted = lambda x: F.concat(F.lit("$"), F.translate(F.format_number(F.col(x), 0), ",", "."))
    line = F.struct(F.when(F.col("page") % 2 == 0, s("part")).alias("codigoGC"), F.when(F.col("page") % 2 == 1, s("part")).alias("codigo"), F.lit("L").alias("descripcion"),
                    dotted("total").alias("valorTotal"), dotted("bonif").alias("bonificacion"), dotted("copago").alias("copago"), F.date_format("ts", "dd/MM/yyyy").alias("fecha"))
    folio = F.struct(F.col("folio").alias("folioPAM"), s("provider").alias("prestadorPrincipal"), F.when(F.col("folio").startswith("R"), F.array(line)).alias("items"),
                     F.when(~F.col("folio").startswith("R"), F.array(F.struct(s("provider").alias("nombrePrestador"), F.array(line).alias("items")))).alias("desglosePorPrestador"))
    doc = F.to_json(F.struct(s("account").alias("account_id"), F.array(folio).alias("folios")))
    return c.select(F.from_json(doc, settlements.SETTLEMENT).alias("p")).select("p.*")


LINES_SQL = "SELECT CAST(account AS VARCHAR) AS account_id, folio, CAST(provider AS VARCHAR) AS provider, CAST(part AS VARCHAR) AS code, total AS valor, bonif, copago, CAST(ts AS TIMESTAMP) AS ts FROM charges"


@query("s02_settlement_lines", f"WITH {CHARGES} {LINES_SQL}")
def s02(spark, sf):
    return s03(spark, sf)


@query("s03_settlement_two_places", f"WITH {CHARGES} {LINES_SQL}")
def s03(spark, sf):
    f = settlements.flatten_settlement(raw_settlements(spark, sf))
    return f.select("account_id", "folio", "provider", "code", "valor", "bonif", "copago", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("a51_duplicate_lines", f"WITH {CHARGES} SELECT DISTINCT account, folio, provider, page, qty FROM charges")
def a51(spark, sf):
    c = star.charges(spark, sf).select("account", "folio", "provider", "page", "qty", F.concat_ws(":", F.col("part").cast("string"), F.col("total").cast("string")).alias("line_id"))
    return settlements.drop_duplicates(c, ["account", "folio", "provider", "page", "qty"]).drop("line_id")


@query("a50_longest_text", f"WITH {DESCRIBED} SELECT account, page, folio, description FROM described QUALIFY row_number() OVER (PARTITION BY account, page, folio ORDER BY length(description) DESC, part, description) = 1")
def a50(spark, sf):
    d = star.described(spark, sf).select("account", "page", "folio", "part", "description").distinct()
    return settlements.keep_longest_text(d, ["account", "page", "folio"], "description", "part").select("account", "page", "folio", "description")


@query("s04_contract_dialects", f"""WITH {RULES} SELECT contract_id || '-' || pos AS contract_id, CASE pos % 4 WHEN 0 THEN 'ENGINE' WHEN 1 THEN 'CANONICAL' WHEN 2 THEN 'HIGH_FIDELITY' ELSE 'PACKAGE' END AS dialect, CASE WHEN pos % 4 = 3 THEN 'DIA CAMA' ELSE domain END AS benefit, modality,
  CASE WHEN pos % 4 = 3 THEN CASE WHEN pct IS NOT NULL THEN pct END ELSE pct END AS pct, 'NO_ENCONTRADO' AS cap_kind FROM rules WHERE pos % 4 = 3 AND pct IS NOT NULL UNION ALL
  SELECT contract_id || '-' || pos, CASE pos % 4 WHEN 0 THEN 'ENGINE' WHEN 1 THEN 'CANONICAL' WHEN 2 THEN 'HIGH_FIDELITY' ELSE 'PACKAGE' END, CASE WHEN pos % 4 = 3 THEN 'DIA CAMA' ELSE domain END, modality, pct, CASE WHEN pos % 4 = 3 THEN 'NUMERICO' WHEN cap_value IS NULL THEN 'SIN_TOPE_EXPLICITO' ELSE 'NUMERICO' END FROM rules WHERE NOT (pos % 4 = 3 AND pct IS NOT NULL)""")
def s04(spark, sf):
    r = star.contract_rules(spark, sf)
    p, none = F.col("pos") % 4, F.lit(None)
    pct = F.when(F.col("pct").isNotNull(), F.concat(F.col("pct").cast("int").cast("string"), F.lit("%")))
    cap = F.when(F.col("cap_value").isNull(), "SIN TOPE").otherwise(F.concat(F.col("cap_value").cast("int").cast("string"), F.lit(" UF")))
    cid = F.concat_ws("-", "contract_id", F.col("pos").cast("string")).alias("contract_id")
    engine = F.to_json(F.struct(cid, F.array(F.struct("domain", F.col("modality").alias("modalidad"), pct.alias("coberturaPct"), cap.alias("tope"))).alias("rules")))
    flat = F.to_json(F.struct(cid, F.array(F.struct(F.col("domain").alias("item"), F.col("modality").alias("tipo_modalidad"), pct.alias("porcentaje"), cap.alias("tope"))).alias("coberturas")))
    high = F.to_json(F.struct(cid, F.array(F.struct(F.col("domain").alias("item"), F.array(F.struct(F.upper("modality").alias("tipo"), pct.alias("porcentaje"), cap.alias("tope"))).alias("modalidades"))).alias("coberturas")))
    side = F.when(F.col("modality") == "preferente", "COL_PREF_PCT").otherwise("COL_LE_PCT")
    atom = F.when(F.col("pct").isNotNull(), F.struct(F.col("pct").cast("int").cast("string").alias("value"), F.lit("%").alias("unit"))).otherwise(F.struct(F.lit("60").alias("value"), F.lit("UF").alias("unit")))
    pack = F.to_json(F.struct(cid, F.array(F.struct(F.lit("R_DIA_CAMA").alias("row_id"), side.alias("column_id"), F.array(atom).alias("atoms"))).alias("assignments")))
    doc = F.when(p == 0, engine).when(p == 1, flat).when(p == 2, high).otherwise(pack)
    raw = r.select(F.from_json(doc, contracts.CONTRACT).alias("c")).select("c.*")
    return contracts.contract_rules(raw).select("contract_id", "dialect", "benefit", "modality", "pct", "cap_kind")


@query("k03_content_records", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def k03(spark, sf):
    return stores.content_records(star.table(spark, sf, "documents").select("doc_id", "text"), "text").select("hash", "doc_id", "copies")


@query("k04_upsert", """WITH e AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), i AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal + 1 END AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
  SELECT coalesce(e.id, i.id) AS id, coalesce(i.v, e.v) AS v, CASE WHEN e.id IS NOT NULL THEN 'old' ELSE 'new' END AS created_at, CASE WHEN i.id IS NOT NULL THEN 'new' ELSE 'old' END AS updated_at FROM e FULL JOIN i ON e.id = i.id""")
def k04(spark, sf):
    c = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), "c_mktsegment", "c_nationkey")
    old = c.filter("c_mktsegment <> 'BUILDING'").select("id", "v", F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"))
    new = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("id", F.when(F.col("c_nationkey") >= 5, F.col("v") + 1).alias("v"))
    return stores.upsert(old, new, "id", F.lit("new"))


@query("k05_examples", "WITH l AS (SELECT doc_id AS example_id, lang AS tag, text, n_chars AS seen FROM documents) SELECT example_id, tag, md5(text) AS digest FROM l QUALIFY row_number() OVER (PARTITION BY tag ORDER BY seen DESC, example_id DESC) <= 2")
def k05(spark, sf):
    e = star.table(spark, sf, "documents").select(F.col("doc_id").alias("example_id"), F.col("lang").alias("tag"), "text", F.col("n_chars").alias("at"))
    return stores.latest_by_tag(stores.keep_examples(e)).select("example_id", "tag", F.md5("text").alias("digest"))


@query("w04_session_windows", """WITH s AS (SELECT user_id, ts, value, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 8 HOURS THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
  SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 8 HOURS AS "end", count(*) AS events FROM n GROUP BY user_id, k""")
def w04(spark, sf):
    return sessions.session_episodes(star.table(spark, sf, "events"), "user_id", gap="8 hours")
