"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

Fixed patterns (email, ip, card, phone) give the base spans, which are the seeds. Tokens with a digit or an at sign are instances; the
word before and the word behind an instance are lexical patterns. Spark scores the graph of both in rounds: a pattern's score is the share of
its occurrences whose instance is believed, an instance's score the mean over its occurrences; seeds stay believed, and a pattern needs
``SUPPORT`` different believed instances. Instances that reach ``LEVEL`` are believed in the next round, and induce patterns as seeds do,
until a round adds none. An occurrence has the score of the word before it, or the mean of both words if that is more: a word before
is a cue whatever follows, a word behind is one alone only where no word stands before. Patterns that are not scored count 0.
What is believed at the end are new identifiers, marked wherever they stand.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows that repeat a doc_id are judged apart.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import BROADCAST_BYTES, bounded, hidden, place, shipped, shown
from saldo.session import checkpoint

KINDS = ("email", "ip", "card", "phone")
SUPPORT, LEVEL = 5, 0.6
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: After the sign. Possessive where the next character cannot be given back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match never begins inside a run of digits: the run's start would match as well.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile("[0-9@]")
EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def instances(text: str, spans: list[tuple[int, int, int]]):
    """(start, end, token, word before, word behind, known) of tokens with a digit or an at sign; a base span counts as one token."""
    taken, end = sorted({(a, b) for _, a, b in spans}), 0
    todo = [(a, b, True) for a, b in taken]
    k = 0
    for m in MARK.finditer(text):
        p = m.start()
        if p < end:
            continue
        a, b = p, p
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            continue
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        if a < b:
            todo.append((a, b, False))
    todo.sort()
    for k, (a, b, known) in enumerate(todo):
        floor, ceiling = todo[k - 1][1] if k else 0, todo[k + 1][0] if k + 1 < len(todo) else len(text)
        yield a, b, text[a:b], word_before(text, a, floor).lower().strip(EDGE), word_behind(text, b, ceiling).lower().strip(EDGE), known


def word_before(text: str, at: int, floor: int) -> str:
    """The whole word that ends before ``at``; where that is the beginning of the same word, it begins at ``floor`` at the least."""
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    start, least = end, floor if end == at else 0
    while start > least and not text[start - 1].isspace():
        start -= 1
    return text[start:end]


def word_behind(text: str, at: int, ceiling: int) -> str:
    """The whole word that begins behind ``at``, and the one behind that if it is punctuation; the end of the same word is cut at ``ceiling``."""
    for _ in range(2):
        start = at
        while start < len(text) and text[start].isspace():
            start += 1
        end, most = start, ceiling if start == at else len(text)
        while end < most and not text[end].isspace():
            end += 1
        if text[start:end].strip(EDGE):
            break
        if end == most < len(text):
            return ""  # the next instance follows in the same word
        at = end
    return text[start:end]


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, of (a hash of the text), counts by kind, base (spans as text) and the instances of every text."""

    def run(batches):
        item = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("token", pa.string()), ("l", pa.string()), ("r", pa.string()), ("known", pa.bool_())])
        for b in batches:
            counts, base, found = [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = base_spans(text)
                counts.append([sum(x[0] == k for x in spans) for k in range(4)])
                base.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans))
                found.append([dict(zip(("s", "e", "token", "l", "r", "known"), x)) for x in instances(text, spans)])
            cols = [b.column(0), b.column(2), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(base, pa.string()), pa.array(found, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "of", *(f"n_{k}" for k in KINDS), "base", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, of long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, found array<struct<s:long,e:long,token:string,l:string,r:string,known:boolean>>"
    rows = bounded(docs.select("doc_id", F.col("text").cast("string"), F.xxhash64("text"))).mapInArrow(run, ddl)
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def discovered(rows: DataFrame, support: int = SUPPORT, level: float = LEVEL) -> DataFrame:
    """token of every new identifier of ``scanned`` rows."""
    at = rows.select(F.explode("found").alias("x")).select("x.token", "x.known", F.concat(F.lit("l:"), "x.l").alias("l"), F.concat(F.lit("r:"), "x.r").alias("r"))
    places = checkpoint(at.groupBy("token", "l", "r", "known").agg(F.count("*").alias("n")))
    edges = places.select("token", "known", "n", F.explode(F.array("l", "r")).alias("pattern")).where(F.length("pattern") > 2)
    edges = checkpoint(edges.groupBy("token", "pattern", "known").agg(F.sum("n").alias("n")))
    base = edges.groupBy("pattern").agg(F.sum(F.col("known").cast("long")).alias("seeds"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("known").cast("long")).alias("sure"))
    base, edges, places = checkpoint(base), edges.where("NOT known"), places.where("NOT known")
    found, size = base.select(F.lit("").alias("token")).limit(0), 0
    while True:
        more = edges.join(shipped(found, 80), "token").groupBy("pattern").agg(F.count("*").alias("new"), F.sum("n").alias("more"))
        both = base.where("seeds > 0").join(more, "pattern", "left") if not size else base.join(more, "pattern", "left")
        score = both.where(F.col("seeds") + F.coalesce("new", F.lit(0)) >= support)
        score = checkpoint(score.select("pattern", ((F.col("sure") + F.coalesce("more", F.lit(0))) / F.col("all")).alias("score")))
        # A larger set never lowers a score, so the set only grows and ends.
        found = checkpoint(beliefs(places, score).where(F.col("belief") >= level).select("token"))
        before, size = size, found.count()
        if size == before:
            return found


def beliefs(places: DataFrame, score: DataFrame) -> DataFrame:
    """token and belief: the mean over the token's ``places`` of what their patterns' scores say."""
    told = places
    for side in ("l", "r"):
        told = told.join(shipped(score.select(F.col("pattern").alias(side), F.col("score").alias(f"{side}_score")), 120), side, "left")
    left, right = F.coalesce("l_score", F.lit(0.0)), F.coalesce("r_score", F.lit(0.0))
    best = F.when(F.col("l") == "l:", right).otherwise(F.greatest(left, (left + right) / 2))
    return told.groupBy("token").agg(F.round(F.sum(F.col("n") * best) / F.sum("n"), 9).alias("belief"))


def find(docs: DataFrame, support: int = SUPPORT, level: float = LEVEL) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and spans (kind:start:end, comma-joined; base spans, then kind id by start) of every row."""
    rows = scanned(docs)
    new = shipped(checkpoint(discovered(rows, support, level)), 80)
    at = rows.select("row", F.explode("found").alias("x")).where("NOT x.known").select("row", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.token").alias("token"))
    # The spans of one text, bounded by its length.
    at = at.join(new, "token").groupBy(F.col("row").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("ids"))
    out = rows.join(at, F.col("row") == F.col("_r"), "left")
    ids = F.concat_ws(",", F.transform("ids", lambda x: F.concat(F.lit("id:"), x["s"], F.lit(":"), x["e"])))
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(ids != "", ids))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), "base", both.alias("spans"), "of")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with a placeholder for each span; a column n_chars follows the text. All other columns stay."""
    spans = checkpoint(find(docs).where("spans <> ''").select(F.col("doc_id").alias("_d"), F.col("of").alias("_of"), F.col("spans").alias("_spans")).dropDuplicates(["_d", "_of"]))
    size = spans.agg(F.sum(F.octet_length("_spans") + 40)).first()[0] or 0
    rows, text = hidden(docs), f"c{place(docs, 'text')}"
    same = rows[f"c{place(docs, 'doc_id')}"].eqNullSafe(F.col("_d")) & (F.xxhash64(rows[text]) == F.col("_of"))
    out = rows.join(F.broadcast(spans) if size <= BROADCAST_BYTES else spans, same, "left")

    def run(text: pa.Array, marks: pa.Array) -> pa.Array:
        return pa.array([t if m is None else redacted(t, m) for t, m in zip(text.to_pylist(), marks.to_pylist())], pa.string())

    run.__annotations__ = {"text": pa.Array, "marks": pa.Array, "return": pa.Array}
    out = bounded(out).withColumn(text, F.arrow_udf(run, "string")(F.col(text).cast("string"), "_spans"))
    if "n_chars" in [c.lower() for c in docs.columns]:
        n = f"c{place(docs, 'n_chars')}"
        out = out.withColumn(n, F.when(F.col("_spans").isNull(), F.col(n)).otherwise(F.length(text)))
    return shown(out, docs)


def redacted(text: str, spans: str) -> str:
    """Overlapping spans become one placeholder of the first's kind."""
    if not spans:
        return text
    all_ = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, at, k = [], 0, 0
    while k < len(all_):
        s, e, kind = all_[k]
        while k + 1 < len(all_) and all_[k + 1][0] < e:
            k += 1
            e = max(e, all_[k][1])
        out += [text[at:s], f"[{kind.upper()}]"]
        at, k = e, k + 1
    return "".join([*out, text[at:]])
