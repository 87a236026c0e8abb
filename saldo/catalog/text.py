"""Texts: phrases, relevance, chunks, synonyms, schedules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import ITEMS, PARTS
from saldo.catalog.registry import query
from saldo.functions import lexicon, text
from saldo.operators import corpus as X
from saldo.sources import star


@query("a55_repeated_phrases", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) > 0) AS ws FROM documents WHERE length(text) >= 100), d AS (SELECT * FROM w WHERE len(ws) >= 20),
  p AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 10], ' ') AS ph FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 9)) AS i FROM d)), c AS (SELECT doc_id, lower(ph) AS k, count(*) AS n, max(i) AS r FROM p WHERE length(lower(ph)) >= 20 GROUP BY ALL),
  b AS (SELECT doc_id, n, r FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, r) = 1) SELECT documents.doc_id, coalesce(n, 0) AS top_count, coalesce(n, 0) >= 5 AS repeated, CASE WHEN n >= 5 THEN ph END AS phrase FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN p ON p.doc_id = b.doc_id AND p.i = b.r""")
def a55(spark, sf):
    return X.repeated_phrases(star.table(spark, sf, "documents"))


# Patterns of words and the documents they point at.
RELEVANCE = {"^the|^and": ["circular"], "tion": ["arancel", "contrato"], "ment|enn": ["arancel"], "haha": ["jurisprudencia"]}


@query("a54_document_relevance", """WITH w AS (SELECT DISTINCT conv_id AS case_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS word FROM conversations), r AS (SELECT * FROM (VALUES ('^the|^and', 'circular'), ('tion', 'arancel'), ('tion', 'contrato'), ('ment|enn', 'arancel'), ('haha', 'jurisprudencia')) t(p, document))
  SELECT case_id, document, count(*) AS score FROM w JOIN r ON regexp_matches(word, p) GROUP BY ALL""")
def a54(spark, sf):
    words = F.filter(F.split(text.fold(F.lower("text")), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    w = star.table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.explode(words).alias("word"))
    return X.keyword_hits(w, RELEVANCE)


CH = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents), ch AS (SELECT doc_id, CAST(line_no // 5 AS INT) AS chunk, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ln GROUP BY ALL)"
KW = ["heed", "tion", "eau", "1103057"]
SCO = f"{CH}, sc AS (SELECT *, contains(lower(text), 'heed')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'eau')::INT + CASE WHEN contains(text, '1103057') THEN 1 WHEN contains(text, '11 03 057') THEN 2 ELSE 0 END AS score FROM ch)"


def chunked(spark, sf):
    return X.chunks(X.document_lines(star.table(spark, sf, "documents")), "doc_id", 5)


@query("s10_corpus_chunks", f"WITH {CH} SELECT doc_id, chunk, md5(text) AS digest FROM ch")
def s10(spark, sf):
    return chunked(spark, sf).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query("a54_chunk_scores", f"WITH {SCO} SELECT doc_id, chunk, score FROM sc WHERE score > 0")
def a54b(spark, sf):
    return X.score_chunks(chunked(spark, sf), KW).filter("score > 0").select("doc_id", "chunk", "score")


@query("o07_budget_cut", f"WITH {SCO}, u AS (SELECT doc_id, chunk, score, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS upto FROM sc WHERE score > 0), k AS (SELECT doc_id, chunk, score, CAST(CASE WHEN upto <= 3000 THEN n WHEN 3000 - (upto - n) > 500 THEN 3000 - (upto - n) ELSE 0 END AS BIGINT) AS kept FROM u) SELECT * FROM k WHERE kept > 0")
def o07(spark, sf):
    return X.within_budget(X.score_chunks(chunked(spark, sf), KW), "doc_id", 3000)


@query("o08_first_rows", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2")
def o08(spark, sf):
    from saldo.operators import sequence
    return sequence.best(star.table(spark, sf, "conversations"), ["conv_id"], [F.col("turn")], 2).select("conv_id", "turn", "role")


@query("j41_canonical_terms", f"WITH {PARTS}, t AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS term FROM parts UNION SELECT DISTINCT upper(p_name) FROM parts), s AS (SELECT min(p_name) AS canonical, lower(p_name) AS k FROM parts GROUP BY lower(p_name)) SELECT term, coalesce(canonical, term) AS canonical FROM t LEFT JOIN s ON s.k = lower(term)")
def j41(spark, sf):
    p = star.parts(spark, sf)
    terms = p.select(F.split("p_name", " ").getItem(1).alias("term")).union(p.select(F.upper("p_name")))
    syn = p.select(F.col("p_name").alias("canonical"), F.array(F.initcap("p_name"), F.concat(F.lit(" "), "p_name")).alias("synonyms")).distinct()
    return X.canonical_terms(terms, syn)


@query("s08_fee_schedule", f"WITH {PARTS} SELECT code, description FROM parts WHERE p_type <> 'SMALL'")
def s08(spark, sf):
    c = F.col("code")
    spaced = F.concat_ws(" ", F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, 5, 3))
    line = F.when(F.col("p_type") != "SMALL", F.concat(F.lit("pag "), spaced, F.lit(" 12 "), "description", F.lit(" 1.234 45.000"))).otherwise(F.col("description"))
    return X.fee_schedule(star.parts(spark, sf).select(line.alias("line"))).select("code", F.regexp_replace("description", "^12 ", "").alias("description"))


@query("s07_sectioned_report", f"""WITH {ITEMS}, m AS (SELECT *, CASE WHEN page % 2 = 1 AND section <> '' THEN section END AS t FROM items), f AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY account ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM m)
  SELECT account, pos * 2 + 1 AS line_no, coalesce(s, 'GENERAL') AS section, [description, CAST(CAST(qty AS INT) AS VARCHAR), CAST(total AS VARCHAR), CAST(copago AS VARCHAR)] AS columns FROM f""")
def s07(spark, sf):
    i = star.bill_items(spark, sf)
    s = lambda c: F.col(c).cast("string")
    head = F.when((F.col("page") % 2 == 1) & (F.col("section") != ""), F.concat(F.lit(" SECTION: "), "section"))
    body = F.concat_ws(" | ", "description", F.col("qty").cast("int").cast("string"), s("total"), s("copago"))
    lines = i.withColumn("_n", F.explode(F.array(F.lit(0), F.lit(1)))).select("account", (F.col("pos") * 2 + F.col("_n")).alias("line_no"), F.when(F.col("_n") == 0, head).otherwise(body).alias("line"))
    return X.sectioned_report(lines, "account")


REF = [("HOTELERIA_NO_CLINICA", ["set de aseo", "toalla"], ["22", "1117"]), ("CUIDADOS_INHERENTES", ["control enfermeria", "trocar"], ["0301"])]


@query("s12_keyword_reference", f"""WITH {PARTS} SELECT part AS item_key, 'HOTELERIA_NO_CLINICA' AS rule_id FROM parts WHERE regexp_matches(lower(description), 'set de aseo|toalla') OR starts_with(code, '22') OR starts_with(code, '1117')
  UNION ALL SELECT part, 'CUIDADOS_INHERENTES' FROM parts WHERE regexp_matches(lower(description), 'control enfermeria|trocar') OR starts_with(code, '0301')""")
def s12(spark, sf):
    arr = lambda v: F.array(*[F.lit(x) for x in v])
    rules = F.array(*[F.struct(F.lit(r).alias("rule_id"), arr(k).alias("keywords"), arr(p).alias("code_prefixes")) for r, k, p in REF])
    ref = star.table(spark, sf, "region").filter("r_regionkey = 0").select(F.explode(rules).alias("r")).select("r.*")
    return X.reference_hits(star.parts(spark, sf).select(F.col("part").alias("item_key"), "description", "code"), ref)
