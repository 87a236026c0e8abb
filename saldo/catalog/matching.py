"""Matching of settlement lines to bill items."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ITEMS, LINES_ONLY, NUMBERED, any_like, strict
from saldo.catalog.classify import CLASS_SQL, DRUG_SQL, SUPPLY_SQL
from saldo.catalog.registry import query
from saldo.functions import lexicon as lx
from saldo.operators import matching as M
from saldo.operators import sequence
from saldo.session import checkpoint
from saldo.sources import star

ND, NS = strict("description"), strict("section")
BOTH = f"{ITEMS}, {LINES_ONLY}"
CUM = f"{NUMBERED}, {LINES_ONLY}, cum AS (SELECT *, sum(total) OVER (PARTITION BY account ORDER BY pos) AS upto FROM items)"
DIST = f"""{BOTH}, anc AS (SELECT account, pos AS ap FROM items WHERE {any_like(ND, lx.ANCHOR_SURGERY + lx.ANCHOR_STAY)}),
  dist AS (SELECT i.account, i.pos, min(abs(i.pos - ap)) AS distance FROM items i LEFT JOIN anc USING (account) GROUP BY ALL)"""


def _items(spark, sf):
    return star.bill_items(spark, sf)


def _bare(spark, sf):
    return star.numbered(star.charges(spark, sf))


@query("w01_section_fill", f"""WITH {ITEMS}, m AS (SELECT *, CASE WHEN regexp_matches(description, 'HMQ|HM -|HM :|CIRUJANO|ANESTESIA') THEN 'HONORARIOS' WHEN regexp_matches(description, 'PABELLON|DERECHO DE SALA|RECUPERACION') THEN 'PABELLON' WHEN regexp_matches(description, 'DIA CAMA|HABITACION') THEN 'DIA_CAMA' END AS mk FROM items)
  SELECT account, pos, CASE WHEN section = '' THEN coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY account ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'GENERAL') ELSE section END AS section FROM m""")
def w01(spark, sf):
    return M.fill_sections(_items(spark, sf)).select("account", "pos", "section")


@query("w02_anchor_distance", f"WITH {DIST} SELECT account, pos, distance FROM dist")
def w02(spark, sf):
    return M.anchor_distance(_items(spark, sf)).select("account", "pos", "distance")


@query("w03_residual_segments", f"""WITH {NUMBERED}, r AS (SELECT account, pos, total FROM items WHERE folio NOT LIKE 'N%'), s AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 2 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM r WINDOW w AS (PARTITION BY account ORDER BY pos))
  SELECT account, pos, CAST(sum(st) OVER (PARTITION BY account ORDER BY pos) AS BIGINT) AS segment FROM s""")
def w03(spark, sf):
    rest = _bare(spark, sf).filter("folio not like 'N%'").select("account", "pos", "total")
    return M.residual_segments(rest).select("account", "pos", "segment")


@query("g01_unit_items", f"""WITH {ITEMS}, e AS (SELECT *, qty > 1 AND unit_price > 0 AND abs(total - qty * CAST(round(total / qty) AS BIGINT)) < total * 0.05 + 10 AS sp, CAST(round(total / qty) AS BIGINT) AS u FROM items)
  SELECT account, pos, sum(CASE WHEN sp THEN ceil(qty) ELSE 1 END)::BIGINT AS units, CAST(sum(CASE WHEN sp THEN u * ceil(qty) ELSE total END) AS BIGINT) AS amount FROM e GROUP BY ALL""")
def g01(spark, sf):
    items = _items(spark, sf).withColumn("unit_price", F.round(F.col("total") / F.col("qty")).cast("long"))
    return M.unit_items(items).groupBy("account", "pos").agg(F.count("*").alias("units"), F.sum("total").alias("amount"))


TXT = "lower(section || ' ' || description)"


@query("p27_event_model", f"""WITH {ITEMS}, g AS (SELECT account, bool_or({any_like(TXT, lx.SURGERY_TEXT)}) AS s, bool_or({any_like(TXT, lx.ANESTHESIA_TEXT)}) AS a, bool_or({any_like(TXT, lx.STAY_TEXT)}) AS has_stay FROM items GROUP BY account)
  SELECT account, s OR a AS has_surgery, has_stay, CASE WHEN s OR a THEN 'CIRUGIA_MAYOR' ELSE 'HOSPITALIZACION_GENERAL' END AS act, a AND NOT s AS inferred FROM g""")
def p27(spark, sf):
    return M.event_model(star.described(spark, sf))


@query("p28_package_origin", f"""WITH {ITEMS}, ev AS (SELECT account, bool_or({any_like(TXT, lx.SURGERY_TEXT)} OR {any_like(TXT, lx.ANESTHESIA_TEXT)}) AS surg FROM items GROUP BY account),
  m AS (SELECT account, account || ':' || folio AS line_id, bool_or({any_like('lower(section)', lx.PACKAGE_SURGERY_SECTION + ['recuperacion'])}) AS a, bool_or({any_like('lower(section)', lx.PACKAGE_STAY_SECTION)}) AS b, bool_or(contains(lower(section), 'urgencia')) AS c,
    bool_or({any_like(ND, lx.PACKAGE_DRUG)}) AS d, bool_or(regexp_matches({ND}, 'mg|ml|amp')) AS e FROM items GROUP BY account, folio)
  SELECT account, line_id, CASE WHEN a THEN 'DERECHO_PABELLON' WHEN b THEN 'DIA_CAMA_INTEGRAL' WHEN c THEN 'URGENCIA' WHEN d OR (surg AND e) THEN 'DERECHO_PABELLON' ELSE 'DIA_CAMA_INTEGRAL' END AS origin FROM m JOIN ev USING (account)""")
def p28(spark, sf):
    d = star.described(spark, sf)
    members = d.withColumn("line_id", F.concat_ws(":", F.col("account").cast("string"), "folio"))
    return M.package_origin(members, M.event_model(d))


def match_sql(coarse: int) -> str:
    """Amount match with totals in steps of ``coarse`` so that amounts repeat."""
    cut = lambda c: f"{c} // {coarse}" if coarse > 1 else c
    return f"""{DIST}, it AS (SELECT i.account, i.pos, i.item_id, {cut('i.total')} AS amount, distance, nd, ns FROM (SELECT *, {ND} AS nd, {NS} AS ns FROM items) i JOIN dist USING (account, pos)),
  fit AS (SELECT *, {DRUG_SQL} AS drug, {SUPPLY_SQL} AS supply FROM it), ln AS (SELECT account, line_id, code, {cut('valor')} AS valor, CASE WHEN code LIKE '320%' THEN 'C' WHEN code = '3101001' OR contains({ND}, 'medicamento') THEN 'D' WHEN code = '3101002' OR contains({ND}, 'material') THEN 'S' END AS dom FROM lines),
  c AS (SELECT ln.*, f.pos, f.item_id, count(f.pos) OVER (PARTITION BY line_id) AS n, row_number() OVER (PARTITION BY line_id ORDER BY distance NULLS LAST, CASE dom WHEN 'D' THEN NOT drug WHEN 'S' THEN NOT supply ELSE false END, f.pos) AS r FROM ln LEFT JOIN fit f ON f.account = ln.account AND f.amount = ln.valor),
  am AS (SELECT account, line_id, code, n AS candidates, CASE WHEN n = 0 THEN 'FAIL' WHEN n = 1 THEN 'OK' ELSE 'PARTIAL' END AS status, pos, item_id FROM c WHERE r = 1)"""


def amount_matches(spark, sf, coarse=1):
    cut = lambda c: F.expr(f"{c} div {coarse}")
    items = M.anchor_distance(_items(spark, sf)).withColumn("total", cut("total"))
    lines = star.settlement_lines(spark, sf).withColumn("valor", cut("valor"))
    return M.amount_match(lines, items).select("account", "line_id", "code", "candidates", "status", "pos", "item_id")


@query("j01_amount_match", f"WITH {match_sql(1)} SELECT * FROM am")
def j01(spark, sf):
    return amount_matches(spark, sf)


@query("j01_amount_or_copago", f"""WITH {CUM}, k AS (SELECT account, total, count(*) AS n FROM items GROUP BY ALL) SELECT l.account, line_id, CASE WHEN a.n IS NOT NULL THEN 'TOTAL' WHEN l.copago > 0 AND b.n IS NOT NULL THEN 'COPAGO' END AS matched_on,
  CASE WHEN coalesce(a.n, CASE WHEN l.copago > 0 THEN b.n END) IS NULL THEN 'FAIL' WHEN coalesce(a.n, b.n) = 1 THEN 'OK' ELSE 'PARTIAL' END AS status FROM lines l LEFT JOIN k a ON a.account = l.account AND a.total = l.valor LEFT JOIN k b ON b.account = l.account AND b.total = l.copago""")
def j01b(spark, sf):
    return M.amount_or_copago_match(star.settlement_lines(spark, sf), star.charges(spark, sf))


@query("j02_best_of_repeated", f"WITH {match_sql(2000000)} SELECT * FROM am")
def j02(spark, sf):
    return amount_matches(spark, sf, 2000000)


@query("j19_unique_consumption", f"""WITH {match_sql(2000000)}, w AS (SELECT *, row_number() OVER (PARTITION BY account, pos, status = 'OK' ORDER BY CASE code WHEN '3101001' THEN 1 WHEN '3101002' THEN 2 WHEN '3201002' THEN 3 WHEN '3201001' THEN 9 ELSE 5 END, line_id) AS k FROM am)
  SELECT account, line_id, code, candidates, CASE WHEN status = 'OK' AND k > 1 THEN 'FAIL' ELSE status END AS status, CASE WHEN status = 'OK' AND k > 1 THEN NULL ELSE pos END AS pos, CASE WHEN status = 'OK' AND k > 1 THEN NULL ELSE item_id END AS item_id FROM w""")
def j19(spark, sf):
    return M.consume_unique(amount_matches(spark, sf, 2000000))


@query("j03_text_match", f"""WITH {BOTH}, l AS (SELECT account, line_id, {strict("code_text")} AS t FROM (SELECT account, line_id, CASE folio WHEN 'AF' THEN 'PARACETAMOL 500 MG TOALLA' WHEN 'NF' THEN 'HONORARIO CIRUJANO NO CUBIERTO' ELSE description END AS code_text FROM lines)),
  i AS (SELECT account, {ND} AS t, count(*) AS n, min(item_id) AS item_id FROM items GROUP BY ALL) SELECT account, line_id, coalesce(n, 0) AS candidates, item_id, CASE WHEN n IS NULL THEN 'FAIL' WHEN n = 1 THEN 'OK' ELSE 'PARTIAL' END AS status FROM l LEFT JOIN i USING (account, t)""")
def j03(spark, sf):
    return M.text_match(_texted(spark, sf), _items(spark, sf))


def _texted(spark, sf):
    f = F.col("folio")
    return star.settlement_lines(spark, sf).withColumn("description", F.when(f == "AF", "PARACETAMOL 500 MG TOALLA").when(f == "NF", "HONORARIO CIRUJANO NO CUBIERTO").otherwise(F.col("description")))


@query("j04_containment_match", f"""WITH {BOTH}, l AS (SELECT account, line_id, {strict("txt")} AS t FROM (SELECT account, line_id, CASE folio WHEN 'AF' THEN '500 mg' WHEN 'NF' THEN 'HONORARIO CIRUJANO' WHEN 'AO' THEN 'COBRO SUTURA VICRYL TOALLA AZUL' ELSE description END AS txt FROM lines)),
  i AS (SELECT account, {ND} AS d, item_id FROM items), c AS (SELECT l.account, line_id, item_id, length(d) AS length, row_number() OVER (PARTITION BY line_id ORDER BY length(d), item_id) AS r FROM l JOIN i ON i.account = l.account AND length(d) > 5 AND (contains(d, t) OR contains(t, d)))
  SELECT account, line_id, item_id, CAST(length AS INT) AS length FROM c WHERE r = 1""")
def j04(spark, sf):
    f = F.col("folio")
    lines = star.settlement_lines(spark, sf).withColumn("description", F.when(f == "AF", "500 mg").when(f == "NF", "HONORARIO CIRUJANO").when(f == "AO", "COBRO SUTURA VICRYL TOALLA AZUL").otherwise(F.col("description")))
    return M.containment_match(lines, _items(spark, sf))


@query("j08_contiguous_match", f"""WITH {CUM}, h AS (SELECT l.account, line_id, valor, a.pos AS first_pos, b.pos AS last_pos, b.pos - a.pos + 1 AS n, row_number() OVER (PARTITION BY line_id ORDER BY a.pos, b.pos) AS r FROM lines l JOIN cum a ON a.account = l.account JOIN cum b ON b.account = l.account AND b.pos >= a.pos WHERE b.upto - a.upto + a.total = valor)
  SELECT account, line_id, valor, first_pos, last_pos, n FROM h WHERE r = 1""")
def j08(spark, sf):
    return M.contiguous_match(star.settlement_lines(spark, sf), _bare(spark, sf))


CONTIG = f"""{BOTH}, cum AS (SELECT *, sum(total) OVER (PARTITION BY account ORDER BY pos) AS upto FROM items), cc AS (SELECT l.account, line_id, a.pos AS first, min(b.pos) AS last FROM lines l JOIN cum a ON a.account = l.account JOIN cum b ON b.account = l.account AND b.pos >= a.pos WHERE abs(b.upto - a.upto + a.total - valor) < 2 GROUP BY ALL)"""


@query("j09_contiguous_candidates", f"WITH {CONTIG} SELECT account, line_id, first AS cand, first, last FROM cc")
def j09(spark, sf):
    return M.contiguous_candidates(star.settlement_lines(spark, sf), _bare(spark, sf))


COMFORT = ["calzon", "aseo", "termometro", "delantal", "mangas", "medias", "confort", "lubricante", "removedor", "adhesivo"]
SCORED = f"""{CONTIG}, mem AS (SELECT cc.line_id, first AS cand, i.*, {ND} AS nd, {NS} AS ns FROM cc JOIN items i ON i.account = cc.account AND i.pos BETWEEN first AND last),
  fa AS (SELECT line_id, cand, count(*) AS size, count(DISTINCT ns) AS sections, bool_or(regexp_matches(ns, 'pabellon|quirurgico')) AS pav, count(*) FILTER (WHERE {any_like('nd', COMFORT)}) AS cf, sum(total) AS s FROM mem GROUP BY ALL),
  sc AS (SELECT l.account, fa.line_id, cand, size, size AS run, sections, CASE WHEN size > 1 THEN size * 5 ELSE 0 END + 10 + CASE WHEN code NOT LIKE '310%' THEN CASE WHEN sections = 1 THEN 50 ELSE -(sections - 1) * 15 END ELSE 0 END
   - CASE WHEN regexp_matches({strict('description')}, 'dia cama|hospitalizacion') AND pav AND code NOT LIKE '310%' THEN 80 ELSE 0 END - CASE WHEN size > 8 THEN (size - 8) * 2 ELSE 0 END + CASE WHEN code IN ('3201001', '3201002') AND cf * 2 >= size THEN 30 ELSE 0 END
   + CASE WHEN code LIKE '310%' AND least(abs(s - copago), abs(s - bonif), abs(s - copago - bonif)) < 2 THEN 40 ELSE 0 END + 80 AS score FROM fa JOIN lines l USING (line_id))"""


def scored(spark, sf):
    # Sums and marks are worked out once, for the ends of the runs and for their members.
    lines, items = star.settlement_lines(spark, sf), M.marked(_items(spark, sf).filter("total >= 0").select("account", "pos", "total", "section", "description"))
    pool = checkpoint(M.prefix_sums(items.drop("section", "description")))
    members = M.run_members(M.contiguous_candidates(lines, pool), pool)
    return M.score_candidates(members, lines, boost=80)


@query("p24_candidate_score", f"WITH {SCORED} SELECT account, line_id, cand, size, run, sections, score FROM sc")
def p24(spark, sf):
    return scored(spark, sf)


@query("o03_ranked_candidates", f"WITH {SCORED} SELECT account, line_id, cand, score, CAST(row_number() OVER (PARTITION BY line_id ORDER BY score DESC, cand) AS INT) AS n FROM sc QUALIFY n <= 3")
def o03(spark, sf):
    return M.ranked_candidates(scored(spark, sf), 3).select("account", "line_id", "cand", "score", "n")


@query("w05_longest_run", f"""WITH {NUMBERED}, m AS (SELECT account, folio, pos, pos - row_number() OVER (PARTITION BY account, folio ORDER BY pos) AS isl FROM items), r AS (SELECT account, folio, isl, count(*) AS n FROM m GROUP BY ALL)
  SELECT account || ':' || folio AS line_id, 0 AS cand, max(n) AS run, CAST(sum(n) AS BIGINT) AS size FROM r GROUP BY account, folio""")
def w05(spark, sf):
    b = _bare(spark, sf).select("account", "folio", "pos")
    k = sequence.number(b, ["account", "folio"], ["pos"], sequence.by_pos(), name="k")
    members = k.select(F.concat_ws(":", F.col("account").cast("string"), "folio").alias("line_id"), F.lit(0).alias("cand"), "pos", "k")
    return M.longest_run(members)


VS = "CASE WHEN ns NOT IN ('', 'sin seccion') THEN ns " + " ".join(f"WHEN {any_like('nd', w)} THEN '{n}'" for n, w in lx.VIRTUAL_SECTION) + " ELSE 'OTROS' END"
BLOCKS = f"{BOTH}, bl AS (SELECT account, {VS} AS block, CAST(sum(total) AS BIGINT) AS amount, count(*) AS items FROM (SELECT *, {ND} AS nd, {NS} AS ns FROM items) GROUP BY ALL)"


@query("a10_section_blocks", f"WITH {BLOCKS} SELECT * FROM bl WHERE amount > 0")
def a10(spark, sf):
    return M.section_blocks(star.described(spark, sf))


@query("j07_block_match", f"WITH {BLOCKS} SELECT l.account, line_id, block, amount FROM lines l JOIN bl ON bl.account = l.account AND abs(amount - valor) < 2")
def j07(spark, sf):
    return M.block_match(star.settlement_lines(spark, sf), M.section_blocks(star.described(spark, sf)))


# Lines that cover whole sections, so that combinations exist.
WIDE = "wl AS (SELECT account, account || ':' || CAST(k AS VARCHAR) AS line_id, CAST(sum(amount) AS BIGINT) AS valor FROM (SELECT account, amount, length(block) % 2 AS k FROM bl) GROUP BY account, k)"


@query("j10_block_combinations", f"""WITH {BLOCKS}, {WIDE}, c AS (SELECT l.account, line_id, [a.block] AS parts, 1 AS k FROM wl l JOIN bl a ON a.account = l.account AND abs(a.amount - valor) < 2
  UNION ALL SELECT l.account, line_id, [a.block, b.block], 2 FROM wl l JOIN bl a ON a.account = l.account JOIN bl b ON b.account = l.account AND b.block > a.block WHERE abs(a.amount + b.amount - valor) < 2 AND a.amount < valor
  UNION ALL SELECT l.account, line_id, [a.block, b.block, c.block], 3 FROM wl l JOIN bl a ON a.account = l.account JOIN bl b ON b.account = l.account AND b.block > a.block JOIN bl c ON c.account = l.account AND c.block > b.block WHERE abs(a.amount + b.amount + c.amount - valor) < 2 AND a.amount + b.amount < valor)
  SELECT account, line_id, parts, k FROM c QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY parts) = 1""")
def j10(spark, sf):
    blocks = checkpoint(M.section_blocks(star.described(spark, sf)))
    lines = blocks.groupBy("account", (F.length("block") % 2).alias("k")).agg(F.sum("amount").alias("valor")).select(
        "account", F.concat_ws(":", F.col("account").cast("string"), F.col("k").cast("string")).alias("line_id"), "valor")
    return M.block_combinations(lines, blocks)


@query("j11_pair_match", f"""WITH {CUM}, h AS (SELECT l.account, line_id, valor, a.pos AS pos_a, b.pos AS pos_b, row_number() OVER (PARTITION BY line_id ORDER BY a.total, a.pos, CASE WHEN a.total = b.total THEN -b.pos ELSE b.pos END) AS r FROM lines l JOIN items a ON a.account = l.account JOIN items b ON b.account = l.account AND b.total = valor - a.total AND b.total >= a.total AND (b.total > a.total OR b.pos > a.pos))
  SELECT account, line_id, valor, pos_a, pos_b FROM h WHERE r = 1""")
def j11(spark, sf):
    return M.pair_match(star.settlement_lines(spark, sf), _bare(spark, sf))


@query("j11_subset_match", f"WITH {CUM} SELECT account, line_id, valor, valor AS matched, true AS once FROM lines")
def j11b(spark, sf):
    hit = M.subset_match(star.settlement_lines(spark, sf), _bare(spark, sf), [F.col("pos")])
    return hit.groupBy("account", "line_id", "valor").agg(F.sum("total").alias("matched"), (F.count_distinct("pos") == F.count("*")).alias("once"))


@query("j11_first_subset", f"""WITH {CUM}, o AS (SELECT line_id, valor, pos, i.total, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS k FROM lines l JOIN items i ON i.account = l.account WHERE i.total > 0 AND i.total <= valor),
  li AS (SELECT line_id, valor, list(total ORDER BY k) AS ts FROM o GROUP BY ALL HAVING sum(total) >= valor),
  mk AS (SELECT line_id, list_filter(range(1, 1 << len(ts)), lambda m: list_sum(list_transform(range(len(ts)), lambda j: CASE WHEN (m >> j) & 1 = 1 THEN ts[j + 1] ELSE 0 END)) = valor)[1] AS m FROM li)
  SELECT line_id, pos, total FROM o JOIN mk USING (line_id) WHERE (m >> k) & 1 = 1""")
def j11d(spark, sf):
    """Members of the subset that is reached first in order: the least bit mask over the positions."""
    return M.subset_match(star.settlement_lines(spark, sf), _bare(spark, sf), [F.col("pos")]).select("line_id", "pos", "total")


@query("j12_anchored_bundle", f"""WITH RECURSIVE {ITEMS}, {LINES_ONLY}, c AS (SELECT account, list({{'pos': pos, 'total': total, 'nd': {strict('description')}}} ORDER BY total DESC, pos) AS its FROM items WHERE {any_like(strict('description'), lx.BUNDLE_WORDS)} GROUP BY account),
  w AS (SELECT account, 0 AS k, its, its[:0] AS chosen FROM c
  UNION ALL SELECT account, k + 1, its, list_concat(chosen, list_filter(its, lambda x: contains(x.nd, {list(lx.BUNDLE_WORDS)}[k + 1]) AND NOT list_contains(list_transform(chosen, lambda a: a.pos), x.pos))[:1]) FROM w WHERE k < {len(lx.BUNDLE_WORDS)}),
  b AS (SELECT account, CAST(len(chosen) AS INTEGER) AS n, CAST(list_sum(list_transform(chosen, lambda a: a.total)) AS BIGINT) AS sum FROM w WHERE k = {len(lx.BUNDLE_WORDS)})
  SELECT account, line_id, valor, n, sum, valor - sum AS gap FROM lines JOIN b USING (account) WHERE code LIKE '320%'""")
def j12(spark, sf):
    lines = star.settlement_lines(spark, sf).filter("code like '320%'")
    return M.anchored_bundle(lines, _items(spark, sf))


def _units(spark, sf):
    """Items; those of two units have a unit price."""
    return _items(spark, sf).withColumn("unit_price", F.when(F.col("qty") == 2, F.expr("total div 2")))


COMBINED = f"""{BOTH}, u AS (SELECT account, pos, unnest(range(1, m + 1)) AS unit, total // m AS total, description, nd, ns, {DRUG_SQL} AS drug, {SUPPLY_SQL} AS supply FROM (SELECT *, {ND} AS nd, {NS} AS ns, CASE WHEN qty = 2 AND total >= 2 THEN 2 ELSE 1 END AS m FROM items)),
  o AS (SELECT line_id, valor, cand, pos, unit, u.total, nd, ns, row_number() OVER (PARTITION BY line_id, cand ORDER BY CASE cand WHEN 1 THEN ns ELSE '' END, CASE cand WHEN 2 THEN -u.total ELSE 0 END, pos, unit) - 1 AS i
    FROM lines l JOIN u ON u.account = l.account, (VALUES (0), (1), (2)) v(cand) WHERE u.total > 0 AND u.total <= valor AND (code NOT LIKE '320%' OR NOT (drug OR supply))),
  li AS (SELECT line_id, cand, valor, list(total ORDER BY i) AS ts FROM o GROUP BY ALL HAVING sum(total) >= valor),
  mk AS (SELECT line_id, cand, list_filter(range(1, 1 << len(ts)), lambda m: list_sum(list_transform(range(len(ts)), lambda k: CASE WHEN (m >> k) & 1 = 1 THEN ts[k + 1] ELSE 0 END)) = valor)[1] AS m FROM li),
  mem AS (SELECT o.*, pos - row_number() OVER (PARTITION BY line_id, cand ORDER BY pos) AS isl FROM o JOIN mk USING (line_id, cand) WHERE (m >> i) & 1 = 1),
  ru AS (SELECT line_id, cand, max(n) AS run FROM (SELECT line_id, cand, isl, count(*) AS n FROM mem GROUP BY ALL) GROUP BY ALL),
  fa AS (SELECT line_id, cand, count(*) AS size, count(DISTINCT ns) AS sections, bool_or(regexp_matches(ns, 'pabellon|quirurgico')) AS pav, count(*) FILTER (WHERE {any_like('nd', COMFORT)}) AS cf, count(*) FILTER (WHERE {any_like('nd', lx.CLINICAL_WORDS)}) AS cl, sum(total) AS s FROM mem GROUP BY ALL),
  sc AS (SELECT fa.line_id, cand, size, CAST(CASE WHEN run > 1 THEN run * 5 ELSE 0 END + CASE WHEN run = size THEN 10 ELSE 0 END + CASE WHEN code NOT LIKE '310%' THEN CASE WHEN sections = 1 THEN 50 ELSE -(sections - 1) * 15 END ELSE 0 END
   - CASE WHEN regexp_matches({strict('description')}, 'dia cama|hospitalizacion') AND pav AND code NOT LIKE '310%' THEN 80 ELSE 0 END - CASE WHEN size > 8 THEN (size - 8) * 2 ELSE 0 END + CASE WHEN code IN ('3201001', '3201002') AND cf * 2 >= size THEN 30 ELSE 0 END
   + CASE WHEN code LIKE '310%' AND least(abs(s - copago), abs(s - bonif), abs(s - copago - bonif)) < 2 THEN 40 ELSE 0 END - CASE WHEN code LIKE '320%' THEN cl * 50 ELSE 0 END AS BIGINT) AS score FROM fa JOIN ru USING (line_id, cand) JOIN lines l USING (line_id)),
  be AS (SELECT line_id, cand, score FROM sc QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY score DESC, cand) = 1)"""


@query("j11_best_combination", f"""WITH {COMBINED} SELECT line_id, cand, score, CASE WHEN score < 20 THEN 'AMBIGUOUS' ELSE 'PARTIAL' END AS status, pos, total FROM mem JOIN be USING (line_id, cand)""")
def j11c(spark, sf):
    items = M.marked(M.pools(_units(spark, sf))).select("account", "pos", "qty", "unit_price", "total", "section", "description", "drug", "supply", "amenity", "unspecific", *M.MARKS)
    return M.combination_match(star.settlement_lines(spark, sf), checkpoint(items)).select("line_id", "cand", "score", "status", "pos", "total")


@query("j12_filled_bundle", f"""WITH RECURSIVE {ITEMS}, {LINES_ONLY}, c AS (SELECT account, list({{'pos': pos, 'total': total, 'nd': {strict('description')}}} ORDER BY total DESC, pos) AS its FROM items WHERE {any_like(strict('description'), lx.BUNDLE_WORDS)} GROUP BY account),
  w AS (SELECT account, 0 AS k, its, its[:0] AS chosen FROM c
  UNION ALL SELECT account, k + 1, its, list_concat(chosen, list_filter(its, lambda x: contains(x.nd, {list(lx.BUNDLE_WORDS)}[k + 1]) AND NOT list_contains(list_transform(chosen, lambda a: a.pos), x.pos))[:1]) FROM w WHERE k < {len(lx.BUNDLE_WORDS)}),
  b AS (SELECT account, list_transform(chosen, lambda a: a.pos) AS taken, CAST(len(chosen) AS INTEGER) AS n, CAST(list_sum(list_transform(chosen, lambda a: a.total)) AS BIGINT) AS sum FROM w WHERE k = {len(lx.BUNDLE_WORDS)}),
  g AS (SELECT account, line_id, valor, n, sum, valor - sum AS gap, taken FROM lines JOIN b USING (account) WHERE code LIKE '320%' AND valor > {lx.BUNDLE_LEAST}),
  r AS (SELECT g.line_id, g.gap, list(i.total ORDER BY i.total DESC, i.pos) AS ts, list(i.pos ORDER BY i.total DESC, i.pos) AS ps FROM g JOIN items i ON i.account = g.account AND NOT list_contains(g.taken, i.pos) AND i.total > 0 AND i.total <= g.gap GROUP BY ALL),
  f AS (SELECT line_id, ps, list_sort(list_transform(list_filter(range(1, 1 << len(ts)), lambda m: bit_count(m) <= 4 AND list_sum(list_transform(range(len(ts)), lambda k: CASE WHEN (m >> k) & 1 = 1 THEN ts[k + 1] ELSE 0 END)) = gap),
    lambda m: list_filter(range(len(ts)), lambda k: (m >> k) & 1 = 1)))[1] AS ix FROM r),
  j AS (SELECT g.*, list_transform(ix, lambda k: ps[k + 1]) AS fill FROM g LEFT JOIN f USING (line_id))
  SELECT line_id, valor, n, CAST(sum + CASE WHEN fill IS NULL THEN 0 ELSE gap END AS BIGINT) AS sum, array_to_string(coalesce(fill, []), ',') AS fill, CASE WHEN n + len(coalesce(fill, [])) >= 3 AND CASE WHEN fill IS NULL THEN abs(gap) ELSE 0 END < 2 THEN 'OK' ELSE 'FAIL' END AS status FROM j""")
def j12b(spark, sf):
    lines = star.settlement_lines(spark, sf).filter("code like '320%'")
    return M.filled_bundle(lines, _items(spark, sf)).select("line_id", "valor", "n", "sum", F.array_join(F.col("fill").cast("array<string>"), ",").alias("fill"), "status")


@query("j13_pool_for_line", f"""WITH {BOTH}, i AS (SELECT account, pos, total, {DRUG_SQL} AS drug, {SUPPLY_SQL} AS supply, {CLASS_SQL['amenity']} AS amenity FROM (SELECT *, {ND} AS nd, {NS} AS ns FROM items)),
  l AS (SELECT account, line_id, valor, CASE WHEN code LIKE '320%' THEN 'CATCH_ALL' WHEN code = '3101001' OR contains({ND}, 'medicamento') THEN 'DRUG' WHEN code = '3101002' OR contains({ND}, 'material') THEN 'SUPPLY' END AS domain FROM lines)
  SELECT line_id, domain, count(*) AS items, CAST(sum(total) AS BIGINT) AS amount FROM l JOIN i ON i.account = l.account AND total <= valor AND CASE domain WHEN 'DRUG' THEN drug WHEN 'SUPPLY' THEN supply WHEN 'CATCH_ALL' THEN amenity ELSE true END GROUP BY ALL""")
def j13(spark, sf):
    p = M.pool_for(star.settlement_lines(spark, sf), _items(spark, sf))
    return p.groupBy("line_id", "domain").agg(F.count("*").alias("items"), F.sum("total").alias("amount"))


@query("a11_running_subtotals", f"""WITH RECURSIVE {NUMBERED}, l AS (SELECT account, pos, CAST(1 + total // 1000000 AS BIGINT) AS t, row_number() OVER (PARTITION BY account ORDER BY pos) AS k FROM items WHERE 1 + total // 1000000 > 0),
  w AS (SELECT account, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(pos BIGINT, t BIGINT)[]) AS open, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS amount, CAST(NULL AS BIGINT) AS n, CAST(NULL AS BIGINT) AS first_pos FROM (SELECT DISTINCT account FROM l)
  UNION ALL SELECT account, k, CASE WHEN n IS NULL THEN list_append(open, {{'pos': pos, 't': t}}) ELSE open[:len(open) - n] END, pos, t, n, open[len(open) - n + 1].pos FROM (
    SELECT w.account, l.k, w.open, l.pos, l.t, list_filter(range(1, len(w.open) + 1), lambda m: abs(list_sum(list_transform(w.open[len(w.open) - m + 1:], lambda o: o.t)) - l.t) < 2)[1] AS n FROM w JOIN l ON l.account = w.account AND l.k = w.k + 1))
  SELECT account, 'B_' || CAST(pos AS VARCHAR) AS item_id, amount, first_pos, pos AS closer_pos, n FROM w WHERE n > 1""")
def a11(spark, sf):
    coarse = _bare(spark, sf).withColumns({"total": F.expr("1 + total div 1000000"), "item_id": F.concat(F.lit("B_"), F.col("pos").cast("string"))})
    return M.running_subtotals(coarse)


@query("o01_line_priority", f"WITH {CUM} SELECT account, line_id, row_number() OVER (PARTITION BY account ORDER BY CASE code WHEN '3101001' THEN 1 WHEN '3101002' THEN 2 WHEN '3201002' THEN 3 WHEN '3201001' THEN 9 ELSE 5 END, line_id) AS n FROM lines")
def o01(spark, sf):
    from saldo.operators import classify as K
    lines = star.settlement_lines(spark, sf).withColumn("prio", K.line_priority(F.col("code")))
    return sequence.number(lines, ["account"], ["prio", "line_id"], F.col("prio").cast("long"), name="n").select("account", "line_id", "n")


@query("o02_largest_first", f"WITH {CUM} SELECT account, line_id, row_number() OVER (PARTITION BY account ORDER BY valor DESC, line_id) AS n FROM lines WHERE code LIKE '320%'")
def o02(spark, sf):
    lines = star.settlement_lines(spark, sf).filter("code like '320%'").withColumn("desc", -F.col("valor"))
    return sequence.number(lines, ["account"], ["desc", "line_id"], F.floor(F.col("desc") / 1000000), name="n").select("account", "line_id", "n")


@query("p23_trace_summary", f"""WITH {match_sql(2000000)}, att AS (SELECT account, line_id, 'MONTO_1A1' AS step, status, 0 AS score, candidates AS matched FROM am UNION ALL SELECT l.account, line_id, 'MONTO_SUBSET', CASE WHEN items <= 2 THEN 'AMBIGUOUS' ELSE 'FAIL' END, 0, 0 FROM lines l)
  SELECT account, line_id, CASE min(CASE status WHEN 'OK' THEN 1 WHEN 'AMBIGUOUS' THEN 2 WHEN 'PARTIAL' THEN 3 ELSE 4 END) WHEN 1 THEN 'OK' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'PARTIAL' ELSE 'FAIL' END AS status,
  CASE WHEN bool_or(step = 'MONTO_1A1' AND status = 'OK') THEN 'TRACE_OK' WHEN max(matched) > 0 THEN 'TRACE_WEAK' ELSE 'TRACE_NONE' END AS level FROM att GROUP BY account, line_id""")
def p23(spark, sf):
    base = {"score": F.lit(0), "explicit": F.lit(False), "domain_pool": F.lit(False)}
    one = amount_matches(spark, sf, 2000000).select("account", "line_id", F.lit("MONTO_1A1").alias("step"), "status", F.col("candidates").alias("matched"))
    sub = star.settlement_lines(spark, sf).select("account", "line_id", F.lit("MONTO_SUBSET").alias("step"), F.when(F.col("items") <= 2, "AMBIGUOUS").otherwise("FAIL").alias("status"), F.lit(0).cast("long").alias("matched"))
    return M.trace_summary(one.unionByName(sub).withColumns(base))


@query("u02_distinct_providers", f"WITH {NUMBERED} SELECT DISTINCT account, provider FROM items")
def u02(spark, sf):
    return star.charges(spark, sf).select("account", "provider").distinct()
