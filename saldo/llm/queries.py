"""One query for each operator, on its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import apportion, density, identifiers, language, positional, quality, quotes, runs, simhash, substrings, urls, variants, warc
from saldo.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(SQL)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = positional.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    of = lambda c: F.sha2(F.concat_ws(",", c), 256)
    n = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id", "n_words", "n_hit", n("item_ids").alias("n_items"), of("item_ids").alias("items_sha256"), "contaminated",
        n("near_ids").alias("n_near"), of("near_ids").alias("near_items_sha256"),
    )


SQL["op1_decontamination"] = r"""
WITH t AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x, doc_id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM p, (SELECT DISTINCT n FROM v) WHERE i + n - 1 <= len(w)),
m AS (SELECT s.doc_id, s.i, s.n, v.item_id FROM s JOIN v ON v.t = s.t AND v.n = s.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1),
o AS (SELECT t, n, i - 1 AS o, string_split(t, ' ')[i] AS word FROM (SELECT DISTINCT t, n, unnest(range(1, n + 1)) AS i FROM v)),
q AS (SELECT doc_id, i, w[i] AS word FROM p WHERE w[i] IN (SELECT word FROM o)),
c AS (SELECT word, count(*) AS k FROM q GROUP BY 1),
r AS (SELECT t, n, o, word, row_number() OVER (PARTITION BY t ORDER BY k, word, o) AS rank FROM o JOIN c USING (word)),
a AS (SELECT q.doc_id, r.t, r.n, i - o AS start FROM q JOIN r ON r.word = q.word AND rank = 1),
e AS (SELECT DISTINCT q.doc_id, r.t, i - o + d AS start FROM q JOIN r ON r.word = q.word AND rank = 2, unnest([-2, -1, 0, 1, 2]) AS u(d)),
k AS (SELECT DISTINCT a.* FROM a LEFT JOIN e USING (doc_id, t, start) WHERE a.n = 1 OR e.t IS NOT NULL),
x AS (SELECT doc_id, t, start, n, o, word, start + o + d AS i FROM k JOIN o USING (t, n), unnest([-2, -1, 0, 1, 2]) AS u(d)),
y AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, t, start, n, count(DISTINCT o) AS near FROM x JOIN q USING (doc_id, i, word) GROUP BY ALL) WHERE 5 * near >= 4 * n),
z AS (SELECT doc_id, count(*) AS n_near, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM y JOIN v USING (t)) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(g.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(z.items, '')) AS near_items_sha256
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN z ON z.doc_id = w.doc_id
"""


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(read(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM s),
late AS (SELECT doc_id, i FROM x QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
k AS (SELECT w.doc_id, u.i, w.w[u.i] AS t FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
j AS (SELECT k.doc_id, count(g.i) AS n_removed, coalesce(string_agg(k.t, ' ' ORDER BY k.i) FILTER (g.i IS NULL), '') AS kept
      FROM k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.i = k.i GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN j ON j.doc_id = w.doc_id
"""


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apportion.mix(read(spark, sf_dir, "documents"))


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op7_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(read(spark, sf_dir, "conversations"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archived(read(spark, sf_dir, "pages"))
    mine = F.col("record_type") == "response"  # a revisit carries the size and digest of what it refers to
    size, digest = F.when(mine, F.col("bytes_so_far")).otherwise(F.col("full_bytes")), F.when(mine, F.col("digest_so_far")).otherwise(F.col("full_digest"))
    return back.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


SQL["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h
"""


@query
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identifiers.find(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def slipped(doc_id, run: str) -> str:
    """A run of letters, less one letter where 97 divides the checksum of its document and itself. A null doc_id counts as no digits."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.counted(read(spark, sf_dir, "documents"), change=slipped))


#: CRC-32 of a text ``s``, by the one list ``t`` of ``crc``.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce([k::BIGINT] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
      FROM (SELECT unnest(range(256)) AS k)))"""
CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(encode(s))), lambda i: (instr('0123456789ABCDEF', substr(hex(encode(s)), (2 * i + 1)::INT, 1)) - 1) * 16
      + instr('0123456789ABCDEF', substr(hex(encode(s)), (2 * i + 2)::INT, 1)) - 1), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"""

SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w
      FROM documents) GROUP BY ALL),
h AS (SELECT w, n, {CRC} AS h FROM (SELECT w, n, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM r), crc),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM d GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
g AS (SELECT word, n, left(word, i - 1) || '_' || substr(word, i + 1) AS k FROM k),
l AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS k FROM k),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM g a JOIN g b ON a.k = b.k AND a.word <> b.word),
e AS (SELECT DISTINCT l.word AS a, v.word AS b FROM l JOIN v ON v.word = l.k),
near AS (SELECT a, b FROM p UNION SELECT a, b FROM e UNION SELECT b, a FROM e),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-v.n, b)) AS b, max(v.n) AS m FROM near JOIN v ON v.word = near.b GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN b END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.a = v.word),
up AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL),
z AS (SELECT up.word, up.at AS root FROM up JOIN f ON f.word = up.at WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(z.root, f.word) AS root FROM f LEFT JOIN z ON z.word = f.word
"""


def looped(doc_id, text: str | None) -> list[bytes]:
    """Words of a text; those of one document in ten repeat from some word on. A text without doc_id stays as it is."""
    words = runs.split(doc_id, text)
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or tenth or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic(read(spark, sf_dir, "documents"), read=looped)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.expr("1000 * top.length div top.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", milli,
                        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


SQL["op12_periodic_runs"] = rf"""
WITH {CRC_TABLE},
w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC} AS h
       FROM (SELECT doc_id, text, coalesce(doc_id::VARCHAR, '') AS s FROM documents), crc),
w1 AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 AND doc_id IS NOT NULL THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM w0),
w AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE w[1:a] || list_transform(range(len(w) - a), lambda k: w[(a + k % (1 + (len(w) - a) // (3 + g % 8)) + 1)::BIGINT]) END AS w FROM w1),
t AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t, len(w) AS n FROM w WHERE len(w) >= 24),
-- Every nine words of a run stand once more in it, a period away: these distances are the periods to try.
k AS (SELECT doc_id, i, n, hash(array_agg(t) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) AS nine FROM t QUALIFY i + 9 <= n),
s AS (SELECT DISTINCT doc_id, j - i AS q FROM (SELECT doc_id, n, i, lead(i) OVER (PARTITION BY doc_id, nine ORDER BY i) AS j FROM k) WHERE (j - i) * 3 <= n),
e AS (SELECT s.doc_id, s.q, a.i FROM s JOIN t a ON a.doc_id = s.doc_id JOIN t b ON b.doc_id = s.doc_id AND b.i = a.i + s.q AND b.t = a.t),
o AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e) GROUP BY doc_id, q, g
      HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.doc_id = o.doc_id AND x.q < o.q AND x.start <= o.start AND x.start + x.length >= o.start + o.length)),
c AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs FROM r GROUP BY 1),
m AS (SELECT doc_id, start, length, q AS period FROM r
      WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.doc_id = r.doc_id AND (x.length * r.q > r.length * x.q OR (x.length * r.q = r.length * x.q AND (x.start, x.q) < (r.start, r.q))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT t.doc_id, sha256(string_agg(t.t, ' ' ORDER BY t.i)) AS kept FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.i = t.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, m.start, m.length::BIGINT AS length, m.period, (1000 * m.length // m.period)::BIGINT AS exponent_milli,
       coalesce(c.runs, sha256('')) AS runs_sha256, coalesce(kept.kept, sha256(array_to_string(w.w, ' '))) AS collapsed_sha256
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.extracted(read(spark, sf_dir, "pages"))


#: On these pages one article element holds the main text.
SQL["op13_main_text"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|em|strong|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(h, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""
