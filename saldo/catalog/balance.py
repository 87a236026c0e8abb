"""Balances, netting, subsumption and gap closing."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, ITEMS, LINES
from saldo.catalog.registry import query
from saldo.catalog.reports import LINE_FINDS, LSUMS, line_findings
from saldo.functions import lexicon as lx
from saldo.operators import balance as B
from saldo.operators import findings as FO
from saldo.operators import reports as R
from saldo.operators import sequence
from saldo.sources import star

# Item-level findings, keyed to the settled line of the item.
IF = "itf AS (SELECT account, account || ':' || folio AS line_id, CASE page % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'Z' ELSE 'K' END AS category, copago * (1 + part % 2) AS amount FROM charges)"


def item_findings(spark, sf):
    c = F.col
    p = c("page") % 4
    return star.charges(spark, sf).select("account", F.concat_ws(":", c("account").cast("string"), "folio").alias("line_id"),
                                                                F.when(p == 0, "A").when(p == 1, "B").when(p == 2, "Z").otherwise("K").alias("category"), (c("copago") * (1 + c("part") % 2)).alias("amount"))


SC = "ss AS (SELECT account, line_id, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (WHERE category = '{k}'), 0) AS BIGINT) AS {k}" for k in "ABKZ") + " FROM itf GROUP BY ALL)"
CAP = "cp AS (SELECT l.account, l.line_id, l.copago, l.provider, " + ", ".join(f"CASE WHEN coalesce(A + B + K + Z, 0) > l.copago AND l.copago > 0 THEN CAST(floor({k} * (l.copago::DOUBLE / (A + B + K + Z)) + 0.5) AS BIGINT) ELSE coalesce({k}, 0) END AS {k}" for k in "ABKZ") + " FROM lines l LEFT JOIN ss USING (account, line_id))"


@query("w13_proportional_capping", f"WITH {LINES}, {IF}, {SC}, {CAP} SELECT line_id, A, B, K, Z FROM cp")
def w13(spark, sf):
    j = star.settlement_lines(spark, sf).join(B.scoped_sums(item_findings(spark, sf)), ["account", "line_id"], "left").withColumns({k: F.coalesce(k, F.lit(0)) for k in "ABKZ"})
    return B.cap_to_copago(j).select("line_id", "A", "B", "K", "Z")


@query("a14_balance_by_capability", f"""WITH {LINES}, {IF}, {SC}, {CAP}, r AS (SELECT *, greatest(0, copago - A - B - K - Z) AS rest, provider % 4 <> 0 AS can FROM cp), g AS (SELECT account, sum(CASE WHEN can THEN A ELSE 0 END) AS A, sum(CASE WHEN can THEN B ELSE 0 END) AS B, sum(CASE WHEN can THEN K ELSE 0 END) AS K, sum(CASE WHEN can AND Z = 0 THEN rest ELSE 0 END) AS OK, sum(CASE WHEN NOT can THEN copago WHEN Z > 0 THEN Z + rest ELSE 0 END) AS Z FROM r GROUP BY account),
  t AS (SELECT account, sum(copago) + account % 3 AS total FROM lines GROUP BY account) SELECT account, CAST(total AS BIGINT) AS total, CAST(A AS BIGINT) AS A, CAST(B AS BIGINT) AS B, CAST(K AS BIGINT) AS K, CAST(OK + CASE WHEN abs(total - A - B - K - OK - Z) > 1 THEN total - A - B - K - OK - Z ELSE 0 END AS BIGINT) AS OK, CAST(Z AS BIGINT) AS Z FROM g JOIN t USING (account)""")
def a14(spark, sf):
    l = star.settlement_lines(spark, sf)
    allowed = l.select("account", "line_id", (F.col("provider") % 4 != 0).alias("allowed"))
    stated = l.groupBy("account").agg((F.sum("copago") + F.col("account") % 3).alias("total"))
    return B.balance_by_capability(l.select("account", "line_id", "copago"), item_findings(spark, sf), allowed, stated)


@query("a15_waterfall", f"""WITH {LINES}, {IF}, s AS (SELECT account, {', '.join(f"CAST(coalesce(sum(amount) FILTER (WHERE category = '{k}'), 0) AS BIGINT) AS {k}" for k in 'ABKZ')} FROM itf GROUP BY account), t AS (SELECT account, CAST(sum(copago) AS BIGINT) AS total FROM lines GROUP BY account),
  o AS (SELECT account, total, A, B, Z + K AS Z, A + B + Z + K > total + 10 AS conflict, greatest(0, A + B + Z + K - total) AS ov FROM s JOIN t USING (account)), c AS (SELECT *, least(Z, ov) AS cz, least(B, ov - least(Z, ov)) AS cb FROM o), r AS (SELECT account, total, CASE WHEN conflict THEN A - least(A, ov - cz - cb) ELSE A END AS A, CASE WHEN conflict THEN B - cb ELSE B END AS B, CASE WHEN conflict THEN Z - cz ELSE Z END AS Z, conflict FROM c)
  SELECT account, total, A, B, Z, greatest(0, total - A - B - Z) AS OK, conflict, CASE WHEN A > 0 THEN CASE WHEN Z > 0 THEN 'COPAGO_MIXTO_CONFIRMADO_Y_OPACO' ELSE 'COPAGO_OBJETABLE_CONFIRMADO' END WHEN Z > 0 THEN 'COPAGO_INDETERMINADO_POR_OPACIDAD' WHEN conflict THEN 'CONFLICTO_DE_EXTRACCION_O_DOBLE_CONTEO' ELSE 'VALIDADO' END AS state,
    greatest(0.05::DOUBLE, least(0.95::DOUBLE, 0.55::DOUBLE + least(1.0::DOUBLE, A::DOUBLE / greatest(1, total)) * 0.35::DOUBLE - Z::DOUBLE / greatest(1, total) * 0.45::DOUBLE - CASE WHEN conflict THEN 0.15::DOUBLE ELSE 0.0 END)) AS confidence, A::DOUBLE / greatest(1, total) * 55 - Z::DOUBLE / greatest(1, total) * 60 AS score FROM r""")
def a15(spark, sf):
    t = star.settlement_lines(spark, sf).groupBy("account").agg(F.sum("copago").alias("total"))
    return B.waterfall(R.category_sums(item_findings(spark, sf)).join(t, "account"))


NF = "nf AS (SELECT account, pos, description AS label, section AS rationale, CASE WHEN pos % 3 = 0 THEN 'A' WHEN pos % 3 = 1 THEN 'Z' ELSE 'B' END AS category, copago AS amount FROM items)"


def net_findings(spark, sf):
    p = F.col("pos") % 3
    return star.bill_items(spark, sf).select("account", "pos", F.col("description").alias("label"), F.col("section").alias("rationale"), F.when(p == 0, "A").when(p == 1, "Z").otherwise("B").alias("category"), F.col("copago").alias("amount"))


def _net(src: str, dst: str, p: str) -> str:
    m = f"regexp_matches(upper(label || ' ' || rationale), '{p}')"
    return f"""{dst}_a AS (SELECT account, sum(amount) AS sa FROM {src} WHERE {m} AND category = 'A' GROUP BY account), {dst}_o AS (SELECT *, CASE WHEN {m} AND category IN ('Z', 'K') THEN amount ELSE 0 END AS op FROM {src}),
  {dst}_c AS (SELECT *, sum(op) OVER (PARTITION BY account ORDER BY pos) - op AS bf FROM {dst}_o), {dst} AS (SELECT account, pos, label, rationale, category, CASE WHEN op > 0 THEN amount - least(amount, greatest(0, coalesce(sa, 0) - bf)) ELSE amount END AS amount FROM {dst}_c LEFT JOIN {dst}_a USING (account))"""


@query("a17_family_netting", f"WITH {ITEMS}, {NF}, {_net('nf', 'n1', 'MEDICAMENTO|INSUMO|MATERIAL|FARMAC')}, {_net('n1', 'n2', 'HOTEL|CAMA|PENSION|ASEO')}, {_net('n2', 'n3', 'PABELLON|EQUIPO|CIRU')} SELECT account, pos, category, CAST(amount AS BIGINT) AS amount FROM n3 WHERE abs(amount) > 10")
def a17(spark, sf):
    return B.net_families(net_findings(spark, sf)).select("account", "pos", "category", "amount")


_ROW = "STRUCT(id VARCHAR, category VARCHAR, amount BIGINT, macro BOOLEAN, generic BOOLEAN, ref VARCHAR, material BOOLEAN)"


def _up(pattern: str) -> str:
    return f"regexp_matches(upper(label), '{pattern}')"


@query("a18_subsumption", f"""WITH RECURSIVE {ITEMS}, {NF}, d AS (SELECT *, {_up(lx.MACRO_FINDING)} AS macro FROM nf WHERE abs(amount) >= 1),
  f AS (SELECT account, row_number() OVER (PARTITION BY account ORDER BY category <> 'A', macro, -abs(amount), pos) AS k, {_up(FO.GLOBAL_MACRO)} AS is_global, {_up(FO.MATERIAL_MACRO)} AS material_macro,
    CAST({{'id': account || ':' || pos, 'category': category, 'amount': abs(amount), 'macro': macro, 'generic': {_up(FO.GENERIC_HOLDER)}, 'ref': 'PAM:' || label, 'material': {_up(FO.MATERIAL_ITEM)}}} AS {_ROW}) AS f FROM d),
  w AS (SELECT account, CAST(0 AS BIGINT) AS k, CAST([] AS {_ROW}[]) AS kept FROM (SELECT DISTINCT account FROM f)
  UNION ALL SELECT account, k, CASE WHEN twin IS NOT NULL THEN list_transform(kept, lambda o, i: CASE WHEN i = twin AND o.category = f.category AND NOT f.macro AND o.generic THEN f ELSE o END)
      WHEN NOT f.macro OR over = 0 THEN list_append(kept, f) WHEN f.amount - over <= 500 THEN kept
      ELSE list_append(kept, CAST({{'id': f.id, 'category': f.category, 'amount': f.amount - over, 'macro': f.macro, 'generic': f.generic, 'ref': f.ref, 'material': f.material}} AS {_ROW})) END FROM (
    SELECT w.account, f.k, w.kept, f.f, list_filter(range(1, len(w.kept) + 1), lambda i: abs(w.kept[i].amount - f.f.amount) < 100)[1] AS twin,
      CAST(coalesce(list_sum(list_transform(w.kept, lambda o: CASE WHEN f.is_global OR f.f.ref = o.ref OR (f.material_macro AND o.material) THEN o.amount ELSE 0 END)), 0) AS BIGINT) AS over
    FROM w JOIN f ON f.account = w.account AND f.k = w.k + 1)),
  e AS (SELECT account, unnest(max_by(kept, k)) AS o FROM w GROUP BY account) SELECT account, o.id AS finding_id, o.category AS category, o.amount AS amount, o.macro AS macro FROM e""")
def a18(spark, sf):
    f = net_findings(spark, sf)
    return FO.subsume(f.withColumns({"finding_id": F.concat_ws(":", F.col("account").cast("string"), F.col("pos").cast("string")), "ref": F.concat(F.lit("PAM:"), "label")}))


@query("a60_final_kpis", f"""WITH {ITEMS}, f AS (SELECT account, CASE WHEN pos % 7 = 0 THEN 'GAP_RECONCILIATION' WHEN pos % 5 = 0 THEN '99-00-028' WHEN pos = 2 THEN 'OPACIDAD_ESTRUCTURAL' ELSE '' END AS code, description AS label, section AS rationale, CASE pos % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'B' END AS category, CASE WHEN page = 6 THEN 'COBRO_IMPROCEDENTE' ELSE 'COPAGO_OPACO' END AS kind, CASE WHEN page % 2 = 0 THEN 'MATCH_EXACTO' END AS anchor, copago AS amount, account % 2 = 0 AS oa FROM items),
  p AS (SELECT *, code = '99-00-028' OR regexp_matches(upper(label || ' ' || rationale), 'UNBUNDLING|EVENTO UNICO|IF-?319|FLEBOCLISIS|VIA VENOSA|ENFERMERIA') OR coalesce(category = 'A', false) OR kind = 'COBRO_IMPROCEDENTE' AS prot FROM f), s AS (SELECT *, oa AND regexp_matches(upper(label), 'MATERIAL|INSUMO|MEDICAMENTO|FARMAC') AND code <> 'OPACIDAD_ESTRUCTURAL' AND NOT prot AS subd FROM p),
  c AS (SELECT account, amount, subd, prot, label, CASE WHEN subd THEN 'B' WHEN code = 'OPACIDAD_ESTRUCTURAL' THEN 'Z' WHEN regexp_matches(upper(label), 'ALIMENTA|NUTRICI') THEN CASE WHEN contains(coalesce(anchor, ''), 'MATCH_EXACTO') THEN 'A' ELSE 'Z' END WHEN code = 'GAP_RECONCILIATION' THEN 'Z' WHEN prot THEN 'A' WHEN category = 'Z' THEN 'Z' ELSE 'B' END AS cat FROM s),
  g AS (SELECT account, CAST(coalesce(sum(amount) FILTER (WHERE NOT subd AND cat = 'A'), 0) AS BIGINT) AS A, CAST(coalesce(sum(amount) FILTER (WHERE NOT subd AND cat = 'B'), 0) AS BIGINT) AS B, CAST(coalesce(sum(amount) FILTER (WHERE NOT subd AND cat = 'Z'), 0) AS BIGINT) AS Z, count(*) FILTER (WHERE subd) AS subsumed, CAST(sum(amount) AS BIGINT) AS total FROM c GROUP BY account)
  SELECT account, A, B, Z, greatest(0, total - A - B - Z) AS OK, subsumed FROM g""")
def a60(spark, sf):
    i = star.bill_items(spark, sf)
    p = F.col("pos")
    f = i.select("account", F.when(p % 7 == 0, "GAP_RECONCILIATION").when(p % 5 == 0, "99-00-028").when(p == 2, "OPACIDAD_ESTRUCTURAL").otherwise("").alias("code"), F.col("description").alias("label"),
                 F.col("section").alias("rationale"), F.when(p % 3 == 0, "Z").when(p % 3 == 1, "B").alias("category"), F.when(F.col("page") == 6, "COBRO_IMPROCEDENTE").otherwise("COPAGO_OPACO").alias("kind"),
                 F.when(F.col("page") % 2 == 0, "MATCH_EXACTO").alias("anchor"), F.col("copago").alias("amount"), (F.col("account") % 2 == 0).alias("opaque_account"))
    return B.kpis(f, star.charges(spark, sf).groupBy("account").agg(F.sum("copago").alias("total")))


GAPS = f"""WITH RECURSIVE {ITEMS}, l AS (SELECT account, pos, copago, row_number() OVER (PARTITION BY account ORDER BY pos) AS k FROM items WHERE regexp_matches(description, 'INSUMO|MATERIAL|TOALLA|ASEO') AND part % 5 <> 0 AND copago > 0), gp AS (SELECT account, CAST(sum(copago) AS BIGINT) // 3 AS gap FROM items GROUP BY account),
  w AS (SELECT account, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS copago, gap AS rest, false AS took FROM gp WHERE gap > 5000 UNION ALL SELECT w.account, l.k, l.pos, l.copago, CASE WHEN l.copago <= w.rest + 500 THEN w.rest - l.copago ELSE w.rest END, l.copago <= w.rest + 500 FROM w JOIN l ON l.account = w.account AND l.k = w.k + 1)"""


def gap_inputs(spark, sf):
    i = star.bill_items(spark, sf)
    lines = i.select("account", "pos", F.col("item_id").alias("line_id"), "copago", F.col("description").rlike("INSUMO|MATERIAL|TOALLA|ASEO").alias("suspicious"), (F.col("part") % 5 == 0).alias("caught"))
    gaps = star.charges(spark, sf).groupBy("account").agg(F.expr("sum(copago) div 3").alias("gap"))
    return lines, gaps


@query("a57_gap_orphans", f"{GAPS} SELECT account, pos, copago FROM w WHERE took")
def a57(spark, sf):
    return B.gap_orphans(*gap_inputs(spark, sf)).select("account", "pos", "copago")


@query("a57_gap_findings", f"""{GAPS} SELECT account, 'ORPHAN' AS code, NULL AS category, pos, copago AS amount FROM w WHERE took
  UNION ALL SELECT account, 'GAP_RECONCILIATION', 'Z', NULL, gap FROM gp WHERE gap > 5000 AND account NOT IN (SELECT account FROM w WHERE took)""")
def a57b(spark, sf):
    return B.gap_findings(*gap_inputs(spark, sf)).select("account", "code", "category", "pos", "amount")
