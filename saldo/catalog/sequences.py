"""Contract lines and printed cells in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES
from saldo.catalog.registry import query
from saldo.operators import layout as L
from saldo.sources import star

TEXT = """CASE p_type WHEN 'STANDARD' THEN p_size || '% sin tope' WHEN 'PROMO' THEN 'PRESTACIONES HOSPITALARIAS' WHEN 'SMALL' THEN 'Solo cobertura libre eleccion' WHEN 'MEDIUM' THEN 'OFERTA PREFERENTE' WHEN 'ECONOMY' THEN 'TOPES DE BONIFICACION' ELSE upper(p_name) END"""
LNS = f"lns AS (SELECT CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INT) AS contract_id, p_partkey AS line_no, p_size AS size, p_type, split_part(p_name, ' ', 2) AS noun, p_name, p_retailprice AS price, {TEXT} AS text FROM part)"
K = ["contract_id"]


def contract_lines(spark, sf):
    p = star.table(spark, sf, "part")
    t, s = F.col("p_type"), F.col("p_size")
    text = F.when(t == "STANDARD", F.concat(s.cast("string"), F.lit("% sin tope"))).when(t == "PROMO", "PRESTACIONES HOSPITALARIAS").when(t == "SMALL", "Solo cobertura libre eleccion").when(
        t == "MEDIUM", "OFERTA PREFERENTE").when(t == "ECONOMY", "TOPES DE BONIFICACION").otherwise(F.upper("p_name"))
    return p.select(F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int").alias("contract_id"), F.col("p_partkey").alias("line_no"), s.alias("size"), "p_type", F.split("p_name", " ").getItem(1).alias("noun"),
                    "p_name", F.col("p_retailprice").alias("price"), text.alias("text"))


@query("w06_sticky_percent", f"""WITH {LNS}, s AS (SELECT *, CASE WHEN p_type = 'STANDARD' THEN size END AS own, CASE WHEN p_type = 'PROMO' THEN -1 WHEN p_type = 'STANDARD' THEN size END AS st FROM lns),
  p AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv FROM s) SELECT contract_id, line_no, CAST(coalesce(own, CASE WHEN pv >= 0 THEN pv END, 90) AS INT) AS pct FROM p""")
def w06(spark, sf):
    return L.sticky_percent(contract_lines(spark, sf), K).select("contract_id", "line_no", "pct")


@query("w06_column_context", f"WITH {LNS} SELECT contract_id, size % 4 AS col, line_no, CAST(last_value(CASE WHEN p_type = 'STANDARD' THEN size END IGNORE NULLS) OVER (PARTITION BY contract_id, size % 4 ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS column_pct FROM lns")
def w06b(spark, sf):
    cells = contract_lines(spark, sf).withColumn("col", F.col("size") % 4)
    return L.column_context(cells, K).select("contract_id", "col", "line_no", "column_pct")


@query("w07_block_propagation", f"""WITH {LNS}, b AS (SELECT *, unnest(['preferente', 'libre_eleccion']) AS modality, CASE WHEN size % 10 < 5 THEN 'preferente' ELSE 'libre_eleccion' END AS own FROM lns),
  s AS (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN -1 WHEN modality = own AND p_type = 'SMALL' THEN -1 WHEN modality = own AND p_type = 'STANDARD' THEN size END AS st FROM b),
  c AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY contract_id, modality ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pct FROM s) SELECT contract_id, line_no, modality, CAST(pct AS INT) AS pct FROM c WHERE p_type = 'LARGE' AND pct >= 0""")
def w07(spark, sf):
    l = contract_lines(spark, sf)
    cells = l.select("contract_id", "line_no", (F.col("size") % 10).alias("col"), "text")
    return L.propagate_blocks(cells, l.select("contract_id", "line_no", "text", (F.col("p_type") == "LARGE").alias("benefit")), K)


@query("w08_cut_inheritance", f"WITH {LNS} SELECT contract_id, line_no, coalesce(last_value(CASE p_type WHEN 'MEDIUM' THEN 0 WHEN 'SMALL' THEN 1 END IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS locked FROM lns")
def w08(spark, sf):
    return L.cut_inheritance(contract_lines(spark, sf), K).select("contract_id", "line_no", "locked")


AB = f"""{LNS}, mk AS (SELECT contract_id, line_no, size AS value, noun IN ('ring', 'bolt') AS is_point, noun = 'gear' AS is_stop FROM lns),
  sp AS (SELECT p.contract_id, p.line_no, p.value, (SELECT max(line_no) FROM mk s WHERE s.contract_id = p.contract_id AND s.is_stop AND s.line_no <= p.line_no) AS st, (SELECT min(line_no) FROM mk s WHERE s.contract_id = p.contract_id AND s.is_stop AND s.line_no > p.line_no) AS en,
    lag(line_no) OVER (PARTITION BY contract_id ORDER BY line_no) AS pv, lead(line_no) OVER (PARTITION BY contract_id ORDER BY line_no) AS nx FROM mk p WHERE is_point),
  ab AS (SELECT contract_id, line_no, value, CASE WHEN pv IS NULL OR pv < coalesce(st, 0) THEN coalesce(st, 0) ELSE pv + 1 END AS first_line, least(en, nx - 1) AS last_line FROM sp)"""


def annual(spark, sf):
    n = F.col("noun")
    return L.annual_blocks(contract_lines(spark, sf).select("contract_id", "line_no", F.col("size").alias("value"), n.isin("ring", "bolt").alias("is_point"), (n == "gear").alias("is_stop")), K)


@query("w09_annual_blocks", f"WITH {AB} SELECT * FROM ab")
def w09(spark, sf):
    return annual(spark, sf)


@query("j37_lines_in_blocks", f"WITH {AB} SELECT l.contract_id, l.line_no, b.line_no AS block FROM lns l JOIN ab b ON b.contract_id = l.contract_id AND l.line_no >= b.first_line AND (b.last_line IS NULL OR l.line_no <= b.last_line)")
def j37(spark, sf):
    from saldo.operators import spatial
    blocks = annual(spark, sf).select("contract_id", F.col("line_no").alias("block"), "first_line", "last_line")
    return spatial.lines_in_blocks(contract_lines(spark, sf).select("contract_id", "line_no"), blocks, K).select("contract_id", "line_no", "block")


GEO = "geo AS (SELECT *, (line_no % 1000) / 1000.0::DOUBLE AS y0, (line_no % 1000) / 1000.0::DOUBLE + 0.004::DOUBLE AS y1 FROM lns)"


def geometry(spark, sf):
    y = (F.col("line_no") % 1000) / 1000.0
    return contract_lines(spark, sf).withColumns({"y0": y, "y1": y + 0.004})


@query("w10_row_groups", f"WITH {LNS}, {GEO} SELECT contract_id, 'G_' || line_no AS group_id, y1 AS y_start, coalesce(lead(y0) OVER (PARTITION BY contract_id ORDER BY y0, line_no), 1.0) AS y_end FROM geo WHERE p_type = 'PROMO'")
def w10(spark, sf):
    return L.row_groups(geometry(spark, sf).withColumnsRenamed({"text": "raw_text", "line_no": "row_id"}), K)


CLU = f"{LNS}, h AS (SELECT contract_id, price, CASE WHEN lag(price) OVER w IS NULL OR lag(price) OVER w - price > 3.5 THEN 1 ELSE 0 END AS st FROM (SELECT DISTINCT contract_id, price FROM lns) WINDOW w AS (PARTITION BY contract_id ORDER BY price DESC)), k AS (SELECT contract_id, price, CAST(sum(st) OVER (PARTITION BY contract_id ORDER BY price DESC) AS BIGINT) AS row_no FROM h)"


def printed(spark, sf):
    return contract_lines(spark, sf).select("contract_id", F.col("line_no").alias("cell_id"), (F.col("size") * 100000 + F.col("line_no")).alias("x"), F.col("price").alias("y"), F.col("p_name").alias("text"))


@query("w11_cell_rows", f"WITH {CLU} SELECT contract_id, line_no AS cell_id, row_no FROM lns JOIN k USING (contract_id, price)")
def w11(spark, sf):
    return L.cluster_rows(printed(spark, sf), K, 3.5).select("contract_id", "cell_id", "row_no")


@query("w11_row_texts", f"WITH {CLU} SELECT contract_id, row_no, count(*) AS cells, string_agg(p_name, ' ' ORDER BY size * 100000 + line_no) AS text FROM lns JOIN k USING (contract_id, price) GROUP BY ALL")
def w11b(spark, sf):
    return L.row_texts(L.cluster_rows(printed(spark, sf), K, 3.5), K)


@query("w12_orphan_amounts", f"""WITH {LNS}, r AS (SELECT contract_id, line_no AS row_no, p_type = 'STANDARD' AS orphan, p_type IN ('PROMO', 'SMALL') AS anchor FROM lns), u AS (SELECT *, CASE WHEN lag(anchor) OVER w THEN lag(row_no) OVER w WHEN lag(anchor, 2) OVER w THEN lag(row_no, 2) OVER w END AS label_row FROM r WINDOW w AS (PARTITION BY contract_id ORDER BY row_no))
  SELECT contract_id, label_row, min(row_no) AS orphan_row FROM u WHERE orphan AND label_row IS NOT NULL GROUP BY ALL""")
def w12(spark, sf):
    t = F.col("p_type")
    text = F.when(t == "STANDARD", F.concat(F.lit("$ "), F.col("size").cast("string"), F.lit(".500"))).when(t.isin("PROMO", "SMALL"), F.concat(F.upper("p_name"), F.lit(" PRESTACION"))).otherwise(F.lit("SUMA 1.200 UF"))
    rows = contract_lines(spark, sf).select("contract_id", F.col("line_no").alias("row_no"), text.alias("text"))
    return L.stitch_orphans(rows, K)


@query("w15_resection", f"""WITH {LNS}, h AS (SELECT contract_id, price, p_name AS section, line_no FROM lns WHERE p_type = 'PROMO'), i AS (SELECT contract_id, price, line_no FROM lns WHERE p_type <> 'PROMO')
  SELECT i.contract_id, CAST(i.line_no AS VARCHAR) AS item_id, arg_min(section, h.price) AS section FROM i JOIN h ON h.contract_id = i.contract_id AND h.price >= i.price GROUP BY ALL""")
def w15(spark, sf):
    l = contract_lines(spark, sf)
    head = l.filter("p_type = 'PROMO'").select("contract_id", F.col("price").alias("y"), F.col("p_name").alias("section"))
    return L.resection(l.filter("p_type <> 'PROMO'").select("contract_id", F.col("price").alias("y"), F.col("line_no").alias("item_id")), head, K)


@query("w16_strict_ids", f"""WITH {CHARGES}, a AS (SELECT provider AS contract_id, 'R' || page AS row_id, 'C' || (part % 3) AS column_id, account, part, total, row_number() OVER (PARTITION BY provider, page, part % 3 ORDER BY account, part, total) AS n FROM charges)
  SELECT contract_id, account, part, total, 'a_' || row_id || '_' || column_id || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS assignment_id FROM a""")
def w16(spark, sf):
    c = star.charges(spark, sf).select(F.col("provider").alias("contract_id"), F.concat(F.lit("R"), F.col("page").cast("string")).alias("row_id"), F.concat(F.lit("C"), (F.col("part") % 3).cast("string")).alias("column_id"), "account", "part", "total")
    return L.strict_ids(c, K, ["account", "part", "total"], F.floor(F.col("account") / 4096)).select("contract_id", "account", "part", "total", "assignment_id")


@query("w18_implicit_scopes", f"""WITH {LNS}, c AS (SELECT contract_id, size % 4 AS col, line_no AS row_no, p_type = 'SMALL' AS blank, p_type <> 'STANDARD' AS word FROM lns), s AS (SELECT *, sum(blank::INT) OVER (PARTITION BY contract_id, col ORDER BY row_no) AS seg FROM c)
  SELECT contract_id, col, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS cells FROM s WHERE NOT blank GROUP BY contract_id, col, seg HAVING count(*) >= 2 AND bool_or(word)""")
def w18(spark, sf):
    t = F.col("p_type")
    text = F.when(t == "SMALL", " ").when(t == "STANDARD", F.col("size").cast("string")).otherwise(F.col("p_name"))
    cells = contract_lines(spark, sf).select("contract_id", (F.col("size") % 4).alias("col"), F.col("line_no").alias("row_no"), text.alias("text"))
    return L.implicit_scopes(cells, K)


@query("j44_nearest_entry", f"""WITH {LNS}, e AS (SELECT contract_id, line_no AS en FROM lns WHERE noun = 'ring'), n AS (SELECT l.contract_id, l.line_no AS row_no, en, row_number() OVER (PARTITION BY l.contract_id, l.line_no ORDER BY abs(l.line_no - en), en) AS r FROM lns l JOIN e USING (contract_id)) SELECT contract_id, row_no, en AS entry_row, en <> row_no AS propagated FROM n WHERE r = 1""")
def j44(spark, sf):
    rows = contract_lines(spark, sf).select("contract_id", F.col("line_no").alias("row_no"), "noun")
    return L.nearest_entry(rows.select("contract_id", "row_no"), rows.filter("noun = 'ring'").select("contract_id", "row_no"), K)
