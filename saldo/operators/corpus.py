"""Texts: repeated phrases, relevance, chunks, synonyms, fee schedules and delimited reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.rules import let
from saldo.functions.text import fold
from saldo.operators import sequence
from saldo.operators.texts import FEW
from saldo.session import checkpoint

PHRASE_WORDS = 10
REPEATED = 5


def repeated_phrases(documents: DataFrame, words: int = PHRASE_WORDS, threshold: int = REPEATED) -> DataFrame:
    """Most frequent phrase of each text and whether it repeats often enough to be flagged.

    Phrases are counted by two hashes instead of their letters; the phrase that reaches the top count first is
    cut from the text again. A text is counted in its own row; texts that share a doc_id are counted together.
    documents: doc_id, text.
    """
    shared = checkpoint(documents.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n = shared.count()
    if n == 0:
        return _counted_alone(documents, words, threshold)
    ids = F.broadcast(shared) if n <= FEW else shared
    alone = _counted_alone(documents.join(ids, "doc_id", "left_anti"), words, threshold)
    return alone.unionByName(_counted_together(documents.join(ids, "doc_id", "left_semi"), words, threshold))


def _counted_alone(documents: DataFrame, words: int, threshold: int) -> DataFrame:
    """Top phrases of texts with a doc_id of their own, without a shuffle. A text without a doc_id has no count."""
    text = lambda t: F.filter(F.split(t, r"\s+"), lambda w: F.length(w) > 0)
    top = F.when(F.col("doc_id").isNotNull() & (F.length("text") >= 100), let(text(F.lower("text")), lambda w: F.when(F.size(w) >= 2 * words, _top_phrase(w, words))))
    count = F.coalesce("top.n", F.lit(0).cast("long"))
    phrase = F.array_join(F.slice(text(F.col("text")), F.col("top.at") + 1, words), " ")
    return documents.withColumn("top", top).select("doc_id", count.alias("top_count"), (count >= threshold).alias("repeated"), F.when(count >= threshold, phrase).alias("phrase"))


def _top_phrase(w: Column, words: int) -> Column:
    """struct(n, at): count of the most frequent phrase of the words and where it is reached, null if all are below 20 letters."""
    starts = F.sequence(F.lit(0), F.size(w) - words)
    cut = lambda i: F.slice(w, i + 1, words)
    long_enough = lambda i: F.length(F.array_join(cut(i), " ")) >= 20
    top = lambda n, at: F.struct(n.cast("long").alias("n"), at.alias("at"))
    # Nothing occurs twice: the first phrase is reached first.
    first = F.when(long_enough(F.lit(0)), F.lit(0)).otherwise(F.array_min(F.filter(starts, long_enough)))
    single = F.when(first.isNotNull(), top(F.lit(1), first))
    # Equal phrases lie side by side, in order of their places, so the last of a run is where its count is reached.
    sorted_ = F.array_sort(F.transform(F.filter(starts, long_enough), lambda i: F.struct(F.xxhash64(cut(i)).alias("h1"), F.hash(cut(i)).alias("h2"), i.alias("i"))))
    state = lambda h1, h2, run, n, at: F.struct(h1.alias("h1"), h2.alias("h2"), run.alias("run"), n.alias("n"), at.alias("at"))

    def step(s: Column, x: Column) -> Column:
        run = F.when((s["h1"] == x["h1"]) & (s["h2"] == x["h2"]) & (s["run"] > 0), s["run"] + 1).otherwise(F.lit(1))
        return let(run, lambda r: let((r > s["n"]) | ((r == s["n"]) & (x["i"] < s["at"])), lambda better: state(
            x["h1"], x["h2"], r, F.when(better, r).otherwise(s["n"]), F.when(better, x["i"]).otherwise(s["at"]))))

    zero = F.lit(0)
    best = F.aggregate(sorted_, state(zero.cast("long"), zero, zero, zero, zero), step, lambda s: F.when(s["n"] > 0, top(s["n"], s["at"])))
    return let(F.transform(starts, lambda i: F.xxhash64(cut(i))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), single).otherwise(best))


def _counted_together(documents: DataFrame, words: int, threshold: int) -> DataFrame:
    """Top phrases over all texts of a doc_id, their phrases dealt over the tasks."""
    ws = F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 0)
    d = documents.filter(F.length("text") >= 100).select("doc_id", ws.alias("ws")).filter(F.size("ws") >= 2 * words)
    starts = F.sequence(F.lit(1), F.size("ws") - words + 1)
    low = F.transform("ws", lambda w: F.lower(w))
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("ws", i, words), " "))
    p = d.select("doc_id", low.alias("ws")).select("doc_id", F.posexplode(phrases).alias("i", "p")).filter(F.length("p") >= 20).select(
        "doc_id", "i", F.xxhash64("p").alias("h1"), F.hash("p").alias("h2"))
    counts = p.groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("reached"))
    top = counts.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "reached")).alias("b")).select("doc_id", (-F.col("b.n")).alias("count"), F.col("b.reached").alias("at"))
    found = top.filter(F.col("count") >= threshold).join(d, "doc_id").select("doc_id", F.array_join(F.slice("ws", F.col("at") + 1, words), " ").alias("phrase"))
    return documents.select("doc_id").join(top, "doc_id", "left").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("count", F.lit(0)).alias("top_count"), (F.coalesce("count", F.lit(0)) >= threshold).alias("repeated"), "phrase")


def keyword_hits(words: DataFrame, relevance: dict[str, list[str]]) -> DataFrame:
    """Documents a case needs: hits of its distinct keywords on the patterns that point at each document."""
    hits = [F.when(F.col("word").rlike(f"(?i){p}"), F.array(*[F.lit(d) for d in docs])) for p, docs in relevance.items()]
    e = words.select("case_id", "word").distinct().select("case_id", F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("document"))
    return e.groupBy("case_id", "document").agg(F.count(F.lit(1)).alias("score"))


def chunks(lines: DataFrame, key: str, size: int = 100) -> DataFrame:
    """Blocks of ``size`` consecutive lines. lines: key, line_no (from 0), line."""
    c = F.floor(F.col("line_no") / size).cast("int")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, c.alias("chunk")).agg(text.alias("text"))


def document_lines(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    return documents.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def score_chunks(chunked: DataFrame, keywords: list[str]) -> DataFrame:
    """Keywords contained in each chunk; a seven-digit code also counts, twice, in its spaced form."""
    low = F.lower("text")
    total = F.lit(0)
    for k in keywords:
        hit = low.contains(k.lower())
        points = F.when(hit, 1)
        if k.isdigit() and len(k) == 7:
            points = points.when(low.contains(f"{k[:2]} {k[2:4]} {k[4:]}"), 2)
        total = total + points.otherwise(0)
    return chunked.withColumn("score", total)


def within_budget(scored: DataFrame, key: str, budget: int, least_part: int = 500) -> DataFrame:
    """Best chunks of each document up to a length; the first that does not fit is cut when enough room is left."""
    s = scored.filter("score > 0").withColumns({"_desc": -F.col("score"), "length": F.length("text").cast("long")})
    r = sequence.carry(s, [key], ["_desc", "chunk"], F.struct("_desc", F.floor(F.col("chunk") / 1024)), sums={"_upto": F.col("length")})
    rest = F.lit(budget) - (F.col("_upto") - F.col("length"))
    kept = F.when(F.col("_upto") <= budget, F.col("length")).when(rest > least_part, rest).otherwise(0)
    return r.select(key, "chunk", "score", kept.cast("long").alias("kept")).filter("kept > 0")


def canonical_terms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Canonical term of each term; a term without an entry stays as it is. synonyms: canonical, synonyms (array)."""
    n = lambda c: F.trim(fold(F.lower(c)))
    s = synonyms.select("canonical", F.explode("synonyms").alias("s")).select(n(F.col("s")).alias("k"), "canonical").groupBy("k").agg(F.min("canonical").alias("canonical"))
    t = terms.select("term").distinct().withColumn("k", n(F.col("term")))
    return t.join(s, "k", "left").select("term", F.coalesce("canonical", "term").alias("canonical"))


def fee_schedule(lines: DataFrame) -> DataFrame:
    """Code and description of the lines of a fee schedule: a spaced code, the text after it up to the first amount."""
    code = F.regexp_extract("line", r"(\d{2}\s\d{2}\s\d{3})", 1)
    rest = F.regexp_extract("line", r"\d{2}\s\d{2}\s\d{3}(.*)$", 1)
    text = F.trim(F.regexp_replace(F.split(F.trim(rest), r"\d{1,3}\.\d{3}").getItem(0), r"^\d+", ""))
    return lines.filter(code != "").select(F.regexp_replace(code, r"\s", "").alias("code"), text.alias("description"))


def sectioned_report(lines: DataFrame, key: str, keyword: str = "SECTION", delimiter: str = "|", min_columns: int = 4) -> DataFrame:
    """Items of a delimited report with the section opened above them. lines: key, line_no, line."""
    t = F.trim("line")
    # Blank lines open no section and are no items.
    title = F.when(F.col("line").startswith(f"{keyword}:"), F.trim(F.expr(f"substring(line, {len(keyword) + 2})")))
    c = sequence.carry(lines.withColumn("line", t), [key], ["line_no"], sequence.by_pos("line_no"), lasts={"section": title})
    cols = F.transform(F.split("line", f"[{delimiter}]"), lambda x: F.trim(x))
    return c.filter(~F.col("line").startswith(f"{keyword}:") & F.col("line").contains(delimiter)).select(
        key, "line_no", F.coalesce("section", F.lit("GENERAL")).alias("section"), cols.alias("columns")).filter(F.size("columns") >= min_columns)


def report_metadata(lines: DataFrame, key: str, names: list[str]) -> DataFrame:
    """KEY: value lines of a report, the last one of each key."""
    rules = F.lit(None).cast("string")
    for n in names:
        rules = F.when(F.trim("line").startswith(f"{n}:"), F.lit(n.lower())).otherwise(rules)
    m = lines.withColumn("name", rules).filter("name is not null")
    value = F.trim(F.regexp_replace(F.trim("line"), r"^[^:]*:", ""))
    return m.groupBy(key, "name").agg(F.max_by(value, "line_no").alias("value"))


def reference_hits(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Rules of a keyword reference that an item text or code meets. reference: rule_id, keywords, code_prefixes (arrays).

    Texts meet keywords through containment of distinct texts; codes meet prefixes cut to every length.
    """
    from saldo.functions.text import normalize_strict
    from saldo.operators.containment import contained

    it = items.select("item_key", normalize_strict(F.col("description")).alias("t"), "code")
    kw = reference.select("rule_id", F.explode("keywords").alias("k")).select("rule_id", normalize_strict(F.col("k")).alias("k")).distinct()
    pairs = contained(it.select("t"), kw.select(F.col("k").alias("t")))
    by_word = it.join(pairs.select(F.col("outer").alias("t"), F.col("inner").alias("k")), "t").join(kw, "k").select("item_key", "rule_id")
    pre = reference.select("rule_id", F.explode("code_prefixes").alias("p")).distinct()
    cut = it.select("item_key", F.explode(F.expr("transform(sequence(1, length(code)), n -> substring(code, 1, n))")).alias("p"))
    return by_word.unionByName(cut.join(pre, "p").select("item_key", "rule_id")).distinct()
