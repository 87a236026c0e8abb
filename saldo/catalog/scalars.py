"""Scalar functions over documents, parts and charges."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, PARTS, strict
from saldo.catalog.registry import query
from saldo.functions import caps, ids, lexicon, money, text
from saldo.sources import star

# A contract-cell text per part, in every spelling the parsers know.
CAP_TEXT_SQL = """CASE p_type WHEN 'STANDARD' THEN size || ' UF' WHEN 'PROMO' THEN 'SIN TOPE'
  WHEN 'SMALL' THEN (size // 10) || ',' || (size % 10) || ' V.A' WHEN 'MEDIUM' THEN CASE WHEN size % 2 = 0 THEN '' ELSE '-' END
  WHEN 'ECONOMY' THEN (size // 10) || ',' || (size % 10) || ' VECES AC2' ELSE CASE WHEN size % 3 = 0 THEN size || '%' ELSE CAST(size AS VARCHAR) END END"""


def cap_text(df):
    size = F.col("size")
    tenth = F.concat((size / 10).cast("int").cast("string"), F.lit(","), (size % 10).cast("string"))
    s = size.cast("string")
    t = F.col("p_type")
    return df.withColumn(
        "cell",
        F.when(t == "STANDARD", F.concat(s, F.lit(" UF"))).when(t == "PROMO", "SIN TOPE")
        .when(t == "SMALL", F.concat(tenth, F.lit(" V.A")))
        .when(t == "MEDIUM", F.when(size % 2 == 0, "").otherwise("-"))
        .when(t == "ECONOMY", F.concat(tenth, F.lit(" VECES AC2")))
        .otherwise(F.when(size % 3 == 0, F.concat(s, F.lit("%"))).otherwise(s)))


CELLS = f"{PARTS}, cells AS (SELECT part, p_name, size, {CAP_TEXT_SQL} AS cell FROM parts)"


def _cells(spark, sf):
    return cap_text(star.parts(spark, sf))


def _doc(name, fn, sql_expr):
    @query(name, f"SELECT doc_id, md5({sql_expr}) AS digest, length({sql_expr}) AS chars FROM documents")
    def run(spark, sf):
        c = fn(F.col("text"))
        return star.table(spark, sf, "documents").select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("chars"))

    return run


_doc("f01_normalize_strict", text.normalize_strict, strict("text"))
# Upper-casing ß gives SS; the check spells that out because its upper() keeps the letter.
UP = "strip_accents(upper(replace(text, 'ß', 'SS')))"
_doc("f02_normalize_upper", text.normalize_upper, f"trim(regexp_replace({UP}, '\\s+', ' ', 'g'))")
_doc("f03_normalize_spaced", text.normalize_spaced,
     f"trim(regexp_replace(regexp_replace({UP}, '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
_doc("f04_normalize_compact", text.normalize_compact, "regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')")
_doc("f05_normalize_soft", text.normalize_soft,
     "trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[.,;:]', '', 'g'), '\\s+', ' ', 'g'))")


@query("f06_clean_benefit_name", f"""WITH {PARTS} SELECT part,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(description || ' (' || size || ') *'), '\\(\\d+\\)', '', 'g'), '[^A-Z0-9_À-ÿ\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name
  FROM parts""")
def f06(spark, sf):
    raw = F.concat("description", F.lit(" ("), F.col("size").cast("string"), F.lit(") *"))
    return star.parts(spark, sf).select("part", text.clean_benefit_name(raw).alias("name"))


@query("f07_clean_code", """SELECT s_suppkey, regexp_replace(trim(' ' || s_name || '-' || s_nationkey || ' '), '[^0-9-]', '', 'g') AS code,
  trim(regexp_replace(s_name || '.' || s_nationkey || ' - ', '[.\\-\\s]', '', 'g')) AS bare FROM supplier""")
def f07(spark, sf):
    s = star.table(spark, sf, "supplier")
    return s.select("s_suppkey", text.clean_code(F.concat(F.lit(" "), "s_name", F.lit("-"), "s_nationkey", F.lit(" "))).alias("code"),
                    text.bare_code(F.concat("s_name", F.lit("."), "s_nationkey", F.lit(" - "))).alias("bare"))


@query("f08_canonical_unit", f"""WITH {CELLS} SELECT part,
  trim(regexp_replace(regexp_replace(regexp_replace(upper(cell), '\\bV\\s*\\.?\\s*A\\b\\.?', ' VA ', 'g'), '\\bVAM\\b', ' VA ', 'g'), '\\s+', ' ', 'g')) AS unit_text,
  CASE WHEN regexp_extract(cell, '[A-Z].*') = '' THEN NULL WHEN regexp_extract(cell, '[A-Z].*') IN ('V.A', 'VAM') THEN 'VA'
       WHEN contains(cell, 'SIN') AND contains(cell, 'TOPE') THEN 'SIN_TOPE' ELSE regexp_extract(cell, '[A-Z].*') END AS unit FROM cells""")
def f08(spark, sf):
    return _cells(spark, sf).select("part", caps.canonical_unit_text(F.col("cell")).alias("unit_text"),
                                    caps.canonical_unit(F.regexp_extract("cell", "[A-Z].*", 0)).alias("unit"))


MONEY_TEXTS = f"""{CHARGES}, texts AS (SELECT DISTINCT total, page,
  CASE page % 5 WHEN 0 THEN '$' || total WHEN 1 THEN replace(format('{{:,}}', total), ',', '.')
    WHEN 2 THEN (total // 100) || ',' || lpad(CAST(total % 100 AS VARCHAR), 2, '0')
    WHEN 3 THEN '(' || replace(format('{{:,}}', total), ',', '.') || ')'
    ELSE format('{{:,}}', total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') END AS raw FROM charges)"""


def _money_texts(spark, sf):
    t, p = F.col("total"), F.col("page") % 5
    whole, rest = F.expr("total div 100"), F.lpad((t % 100).cast("string"), 2, "0")
    dotted = F.translate(F.format_number(t, 0), ",", ".")
    raw = (F.when(p == 0, F.concat(F.lit("$"), t.cast("string"))).when(p == 1, dotted)
           .when(p == 2, F.concat(whole.cast("string"), F.lit(","), rest))
           .when(p == 3, F.concat(F.lit("("), dotted, F.lit(")")))
           .otherwise(F.concat(F.format_number(whole, 0), F.lit("."), rest)))
    return star.charges(spark, sf).select("total", "page").distinct().withColumn("raw", raw)


@query("f09_parse_whole_money", f"WITH {MONEY_TEXTS} SELECT total, page, CAST(regexp_replace(raw, '[^0-9-]', '', 'g') AS BIGINT) AS amount FROM texts")
def f09(spark, sf):
    return _money_texts(spark, sf).select("total", "page", money.parse_whole(F.col("raw")).alias("amount"))


@query("f10_parse_decimal_comma", f"""WITH {MONEY_TEXTS} SELECT total, page, CASE page % 5 WHEN 1 THEN CAST(total AS DOUBLE)
  WHEN 2 THEN CAST(replace(raw, ',', '.') AS DOUBLE) WHEN 4 THEN coalesce(TRY_CAST(regexp_extract(regexp_replace(replace(raw, '.', ''), ',', '.'), '^\\d+(\\.\\d*)?') AS DOUBLE), 0) ELSE 0 END AS amount FROM texts""")
def f10(spark, sf):
    return _money_texts(spark, sf).select("total", "page", money.parse_decimal_comma(F.col("raw")).alias("amount"))


@query("f11_parse_mixed_money", f"""WITH {MONEY_TEXTS} SELECT total, page, CASE WHEN page % 5 IN (0, 1) THEN CAST(total AS DOUBLE)
  WHEN page % 5 = 3 THEN -CAST(total AS DOUBLE) ELSE CAST((total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS amount,
  CASE WHEN page % 5 = 0 THEN CAST(total AS DOUBLE)
       WHEN page % 5 IN (1, 3) THEN (CASE WHEN page % 5 = 3 THEN -1 ELSE 1 END) * CASE WHEN total < 1000000 THEN CAST((total // 1000) || '.' || lpad(CAST(total % 1000 AS VARCHAR), 3, '0') AS DOUBLE) ELSE CAST(total AS DOUBLE) END
       ELSE CAST((total // 100) || '.' || lpad(CAST(total % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS quantity FROM texts""")
def f11(spark, sf):
    return _money_texts(spark, sf).select("total", "page", money.parse_mixed(F.col("raw")).alias("amount"),
                                          money.parse_mixed(F.col("raw"), quantity=True).alias("quantity"))


@query("f12_round_money", """SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS up, CAST(floor(-c_acctbal + 0.5) AS BIGINT) AS down,
  CAST(coalesce(floor(CASE WHEN c_nationkey < 5 THEN NULL ELSE c_acctbal END + 0.5), 0) AS BIGINT) AS clamped FROM customer""")
def f12(spark, sf):
    b = F.col("c_acctbal")
    return star.table(spark, sf, "customer").select(
        "c_custkey", money.round_half_up(b).alias("up"), money.round_half_up(-b).alias("down"),
        money.round_half_up(F.when(F.col("c_nationkey") >= 5, b)).alias("clamped"))


@query("f13_null_safe_sum", f"""WITH {CHARGES} SELECT folio, CAST(coalesce(sum(CASE WHEN folio = 'AF' THEN NULL ELSE total END), 0) AS BIGINT) AS amount
  FROM charges GROUP BY folio""")
def f13(spark, sf):
    return star.charges(spark, sf).groupBy("folio").agg(money.total(F.when(F.col("folio") != "AF", F.col("total"))).alias("amount"))


@query("f14_format_money", """SELECT c_custkey, CASE WHEN v < 0 THEN '-$' ELSE '$' END || replace(format('{:,}', abs(v)), ',', '.') AS shown
  FROM (SELECT c_custkey, CAST(round((c_acctbal - 4000) * 100) AS BIGINT) AS v FROM customer)""")
def f14(spark, sf):
    v = star.money(F.col("c_acctbal") - 4000)
    return star.table(spark, sf, "customer").select("c_custkey", money.format_money(v).alias("shown"))


@query("f15_parse_date", """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders""")
def f15(spark, sf):
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return star.table(spark, sf, "orders").select("o_orderkey", money.parse_date(written).cast("timestamp_ntz").alias("day"))


@query("f16_strict_cap", f"""WITH {CELLS}, n AS (SELECT *, TRY_CAST(replace(regexp_extract(cell, '\\d+(?:[.,]\\d+)?'), ',', '.') AS DOUBLE) AS v FROM cells)
  SELECT part, CASE WHEN cell IN ('', '-') THEN 'NO_ENCONTRADO' WHEN cell = 'SIN TOPE' THEN 'SIN_TOPE_EXPLICITO' ELSE 'NUMERICO' END AS kind,
    CASE WHEN cell LIKE '%UF' THEN 'UF' WHEN cell LIKE '%V.A' THEN 'VA' END AS unit, CASE WHEN cell NOT IN ('', '-', 'SIN TOPE') THEN v END AS value,
    CASE WHEN cell IN ('', '-') THEN 'CELDA_VACIA_OCR' WHEN cell = 'SIN TOPE' THEN 'SIN_TOPE_EXPRESO_EN_CONTRATO'
         WHEN cell LIKE '%UF' OR cell LIKE '%V.A' THEN NULL ELSE 'UNIDAD_NO_DETECTADA' END AS reason FROM n""")
def f16(spark, sf):
    return _cells(spark, sf).select("part", caps.strict_cap(F.col("cell")).alias("c")).select("part", "c.*")


@query("f17_ceiling_factor", f"""WITH {CELLS} SELECT part, CASE WHEN cell LIKE '%AC2' THEN CAST(replace(split_part(cell, ' ', 1), ',', '.') AS DOUBLE) ELSE 0 END AS factor,
  CASE WHEN cell LIKE '%AC2' THEN 'AC2' ELSE 'UNKNOWN' END AS unit FROM cells""")
def f17(spark, sf):
    return _cells(spark, sf).select("part", caps.ceiling_factor(F.col("cell")).alias("c")).select("part", "c.*")


@query("f18_cell_atom", f"""WITH {CELLS} SELECT part, CASE WHEN cell LIKE '%UF' OR cell LIKE '%V.A' OR cell LIKE '%!%' ESCAPE '!' THEN TRY_CAST(replace(regexp_extract(cell, '\\d+(?:,\\d+)?'), ',', '.') AS DOUBLE) END AS value,
  CASE WHEN cell = 'SIN TOPE' THEN 'NONE' WHEN cell LIKE '%UF' THEN 'UF' WHEN cell LIKE '%V.A' THEN 'V.A.' WHEN ends_with(cell, '%') THEN '%' ELSE 'UNKNOWN' END AS unit,
  CASE WHEN cell = 'SIN TOPE' OR cell LIKE '%UF' OR cell LIKE '%V.A' OR ends_with(cell, '%') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM cells""".replace("cell LIKE '%!%' ESCAPE '!'", "ends_with(cell, '%')"))
def f18(spark, sf):
    return _cells(spark, sf).select("part", caps.cell_atom(F.col("cell")).alias("c")).select("part", "c.*")


@query("f19_ac2_multiple", f"""WITH {CELLS} SELECT part, CASE WHEN cell LIKE '%VECES AC2' THEN CAST(replace(split_part(cell, ' ', 1), ',', '.') AS DOUBLE) END AS multiple,
  CASE WHEN cell = '' OR cell = 'SIN TOPE' THEN 'SIN_TOPE' WHEN cell LIKE '%UF' THEN 'UF' WHEN cell LIKE '%AC2' THEN 'AC2' ELSE 'VARIABLE' END AS kind FROM cells""")
def f19(spark, sf):
    return _cells(spark, sf).select("part", caps.ac2_multiple(F.col("cell")).alias("multiple"),
                                    caps.line_cap(F.col("cell"))["kind"].alias("kind"))


@query("f20_cap_clauses", f"""WITH {PARTS}, c AS (SELECT part, size, unnest([1, 2]) AS k FROM parts)
  SELECT part, k - 1 AS n, CASE k WHEN 1 THEN 'NACIONAL' ELSE 'INTERNACIONAL' END AS scope, CASE k WHEN 1 THEN 'TOPE_EVENTO' ELSE 'TOPE_ANUAL' END AS kind,
    CAST(CASE k WHEN 1 THEN size ELSE size * 10 END AS DOUBLE) AS factor, CASE k WHEN 1 THEN 'UF' ELSE 'VAM' END AS unit,
    CASE k WHEN 1 THEN 70 END AS exception_pct FROM c""")
def f20(spark, sf):
    s = F.col("size").cast("string")
    written = F.concat(s, F.lit(" UF excepto 70% en Centro Norte / "), (F.col("size") * 10).cast("string"), F.lit(" VAM (anual) internacional"))
    return star.parts(spark, sf).select("part", F.posexplode(caps.cap_clauses(written)).alias("n", "c")).select("part", "n", "c.*")


@query("f21_percent_cell", f"""WITH {CELLS} SELECT part, CASE WHEN cell = '-' THEN 0 WHEN cell = '' THEN NULL WHEN ends_with(cell, '%') THEN CAST(size AS DOUBLE)
  WHEN cell LIKE '%UF' OR cell LIKE '%AC2' OR cell = 'SIN TOPE' THEN NULL WHEN cell LIKE '%V.A' THEN CASE WHEN size > 10 THEN size / 10.0::DOUBLE END
  WHEN size > 1 THEN CAST(size AS DOUBLE) END AS pct FROM cells""")
def f21(spark, sf):
    return _cells(spark, sf).select("part", caps.percent_cell(F.col("cell")).alias("pct"))


LINE_TEXT_SQL = "description || ' ' || qty::INT || ' ' || replace(format('{:,}', total), ',', '.') || ' ' || replace(format('{:,}', copago), ',', '.')"


def charge_text(df):
    """A printed bill row: description, quantity, total and copago."""
    dotted = lambda c: F.translate(F.format_number(F.col(c), 0), ",", ".")
    return df.withColumn("raw", F.concat_ws(" ", "description", F.col("qty").cast("int").cast("string"), dotted("total"), dotted("copago")))


@query("f22_number_tokens", f"""WITH {DESCRIBED}, d AS (SELECT DISTINCT description, qty, total, copago FROM described), l AS (SELECT {LINE_TEXT_SQL} AS raw FROM d),
  t AS (SELECT raw, list_filter(list_transform(regexp_extract_all(raw, '\\d{{1,3}}(?:\\.\\d{{3}})+(?:,\\d+)?|\\d+(?:,\\d+)?'), lambda x: CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE)), lambda x: x > 0) AS n FROM l)
  SELECT raw, n AS numbers, CAST(floor(list_max(n) + 0.5) AS BIGINT) AS largest,
    CASE WHEN len(n) < 2 THEN 0 ELSE CAST(floor(greatest(n[-1], n[-2]) + 0.5) AS BIGINT) END AS charge FROM t""")
def f22(spark, sf):
    lines = charge_text(star.described(spark, sf).select("description", "qty", "total", "copago").distinct())
    return lines.select("raw", money.number_tokens(F.col("raw")).alias("numbers"), money.largest_amount(F.col("raw")).alias("largest"),
                        money.primary_charge(F.col("raw")).alias("charge"))


@query("f24_stable_id", """SELECT s_suppkey, regexp_replace(s_name || '|' || 'grupo ' || s_nationkey, '\\s+', '_', 'g') AS id,
  'B_' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS padded FROM supplier""")
def f24(spark, sf):
    return star.table(spark, sf, "supplier").select(
        "s_suppkey", ids.stable_id(F.col("s_name"), F.concat(F.lit("grupo "), "s_nationkey")).alias("id"),
        ids.padded_id("B_", F.col("s_suppkey")).alias("padded"))


@query("f25_fingerprint", f"WITH {PARTS} SELECT part, sha1(concat_ws(chr(31), description, section, CAST(size AS VARCHAR))) AS fp FROM parts")
def f25(spark, sf):
    return star.parts(spark, sf).select("part", ids.fingerprint(F.col("description"), F.col("section"), F.col("size")).alias("fp"))


@query("f26_content_hash", "SELECT page_id, sha256(html) AS hash FROM pages")
def f26(spark, sf):
    return star.table(spark, sf, "pages").select("page_id", ids.content_hash(F.col("html")).alias("hash"))


@query("f27_clamp", "SELECT event_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (value - 10) / 20)) AS clamped FROM events")
def f27(spark, sf):
    return star.table(spark, sf, "events").select("event_id", money.clamp01((F.col("value") - 10) / 20).alias("clamped"))


@query("f28_ratio", f"""WITH {CHARGES}, g AS (SELECT folio, provider, sum(bonif)::DOUBLE AS b, sum(total)::DOUBLE AS t FROM charges GROUP BY ALL)
  SELECT folio, provider, CASE WHEN b > 0 THEN t / b ELSE 0 END AS back, printf('%.1f%%', CASE WHEN t > 0 THEN b / t ELSE 0 END * 100) AS shown FROM g""")
def f28(spark, sf):
    g = star.charges(spark, sf).groupBy("folio", "provider").agg(F.sum("bonif").alias("b"), F.sum("total").alias("t"))
    return g.select("folio", "provider", money.ratio(F.col("t"), F.col("b")).alias("back"),
                    money.percent_text(money.ratio(F.col("b"), F.col("t"))).alias("shown"))


_STOP = ", ".join(f"'{w}'" for w in lexicon.STOPWORDS)


@query("f29_significant_words", f"""SELECT conv_id, turn, list_sort(CASE WHEN length(trim(lower(text))) > 5 AND length(trim(lower(text))) < 50
    THEN list_distinct(list_append(w, trim(lower(text)))) ELSE w END) AS words FROM (SELECT conv_id, turn, text,
  list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN ({_STOP}))) AS w FROM conversations)""")
def f29(spark, sf):
    return star.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array_sort(text.significant_words(F.col("text"), lexicon.STOPWORDS)).alias("words"))


@query("f30_term_match", "SELECT doc_id, regexp_matches(n, '\\bthe\\b') AS short_term, contains(n, 'heed') AS long_term FROM (SELECT doc_id, strip_accents(lower(text)) AS n FROM documents)")
def f30(spark, sf):
    n = text.fold(F.lower("text"))
    return star.table(spark, sf, "documents").select("doc_id", text.has_term(n, "the").alias("short_term"), text.has_term(n, "heed").alias("long_term"))


@query("f31_exception_providers", f"""WITH {PARTS} SELECT part, CASE WHEN size % 2 = 0 THEN [description, 'Centro Norte'] END AS providers FROM parts""")
def f31(spark, sf):
    written = F.when(F.col("size") % 2 == 0, F.concat(F.lit("90% salvo 70% en "), "description", F.lit(", Centro Norte"))).otherwise(F.lit("90% sin tope"))
    return star.parts(spark, sf).select("part", text.exception_providers(written).alias("providers"))


@query("f32_repair_mojibake", "SELECT doc_id, md5(text) AS digest FROM documents")
def f32(spark, sf):
    broken = F.col("text")
    for bad, good in text.MOJIBAKE[:7]:
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    return star.table(spark, sf, "documents").select("doc_id", F.md5(text.repair_mojibake(broken)).alias("digest"))


@query("f33_json_probe", "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.q') AS INT), TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS k FROM events")
def f33(spark, sf):
    p = F.col("props")
    return star.table(spark, sf, "events").select(
        "event_id", F.coalesce(F.get_json_object(p, "$.q"), F.get_json_object(p, "$.k")).cast("int").alias("k"))


@query("f34_array_helpers", """WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1)
  SELECT l_orderkey, s AS providers, list_has_any(s, [1::BIGINT, 2, 3, 5, 8]) AS touches, list_has_all(s, [1::BIGINT]) AS includes FROM g""")
def f34(spark, sf):
    g = star.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("providers"))
    known = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3, 5, 8)])
    return g.select("l_orderkey", "providers", F.arrays_overlap("providers", known).alias("touches"),
                    (F.size(F.array_except(F.array(F.lit(1).cast("long")), F.col("providers"))) == 0).alias("includes"))


@query("f35_interval_tests", """SELECT event_id, (value >= 10 - 0.01 AND value <= 20 + 0.01) AS inside, (value < 20 AND value + 1 > 10) AS overlap FROM events""")
def f35(spark, sf):
    v = F.col("value")
    return star.table(spark, sf, "events").select(
        "event_id", caps.between(v, F.lit(10), F.lit(20)).alias("inside"), caps.overlaps(v, v + 1, F.lit(10), F.lit(20)).alias("overlap"))


@query("p53_financial_term", f"""WITH {CELLS} SELECT part, CASE WHEN cell = '' THEN 'EMPTY' WHEN cell = 'SIN TOPE' THEN 'SIN_TOPE' WHEN cell = '-' THEN 'UNKNOWN' ELSE 'NUMERIC' END AS state,
  TRY_CAST(replace(regexp_extract(cell, '\\d+(?:,\\d+)?'), ',', '.') AS DOUBLE) AS amount,
  CASE WHEN cell = 'SIN TOPE' THEN 'SIN_TOPE' WHEN cell LIKE '%UF' THEN 'UF' WHEN cell LIKE '%AC2' THEN 'AC2' END AS unit FROM cells""")
def p53(spark, sf):
    return _cells(spark, sf).select("part", caps.financial_term(F.col("cell")).alias("c")).select("part", "c.*")
