"""Matching settlement lines to bill items: by amount, text, contiguous runs, blocks and subsets.

Items carry account, pos (document order), item_id, total, section, description; lines carry account,
line_id, code, description, valor, bonif, copago. The item side is reduced to one row per key before
it meets the lines, so repeated amounts or texts never multiply.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.rules import first_match, let
from saldo.functions.text import contains_any, normalize_strict
from saldo.operators import classify as K
from saldo.operators import sequence
from saldo.operators.containment import either_way
from saldo.operators.subsets import subset_match, subset_of  # noqa: F401
from saldo.operators.texts import by_text
from saldo.session import checkpoint

#: Sums of a range: runs that end within one unit of a line are looked up by range.
RANGE = 16
#: Items of an account up to which runs are looked for in one row.
FEW = 32
#: What ``marked`` adds to an item.
MARKS = ["_section", "_pavilion", "_comfort", "_clinical"]

# -- preparation --------------------------------------------------------------

def fill_sections(items: DataFrame) -> DataFrame:
    """Blank sections take the section opened by the last keyword item before them."""
    d = F.upper("description")
    marker = first_match([("HONORARIOS", d.rlike("HMQ|HM -|HM :|CIRUJANO|ANESTESIA")), ("PABELLON", d.rlike("PABELLON|DERECHO DE SALA|RECUPERACION")),
                          ("DIA_CAMA", d.rlike("DIA CAMA|HABITACION"))], None)
    filled = sequence.carry(items, ["account"], ["pos"], sequence.by_pos(), lasts={"_open": marker})
    blank = F.coalesce(F.col("section"), F.lit("")) == ""
    return filled.withColumns({"original_section": F.col("section"),
                               "section": F.when(blank, F.coalesce("_open", F.lit("GENERAL"))).otherwise(F.col("section"))}).drop("_open")


def anchor_distance(items: DataFrame) -> DataFrame:
    """Distance in positions to the nearest package item (operating room or bed-day); null in an account without one."""
    d = normalize_strict(F.col("description"))
    known = by_text(items, ["description"], {"_anchor": contains_any(d, lx.ANCHOR_SURGERY) | contains_any(d, lx.ANCHOR_STAY)})
    anchor = F.when(F.col("_anchor"), F.col("pos"))
    c = sequence.carry(known, ["account"], ["pos"], sequence.by_pos(), lasts={"_before": anchor}, nexts={"_after": anchor})
    near = F.least(F.col("pos") - F.col("_before"), F.col("_after") - F.col("pos"))
    return c.withColumn("distance", near).drop("_before", "_after", "_anchor")


def residual_segments(items: DataFrame, gap: int = 2) -> DataFrame:
    """Runs of the remaining items: a new segment where the position steps by more than ``gap``."""
    return sequence.islands(items, ["account"], "pos", gap)


def unit_items(items: DataFrame, most: int | None = None) -> DataFrame:
    """Items of two or more units (up to ``most``) with a consistent price become one row per unit."""
    q, u, t = F.col("qty"), F.col("unit_price"), F.col("total")
    splits = (q > 1) & (u > 0) & (F.abs(t - q * u) < t * 0.05 + 10)
    if most is not None:
        splits = splits & (q <= most)
    n = F.when(splits, F.ceil(q)).otherwise(1).cast("int")
    e = items.withColumn("_n", n).withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return e.withColumns({"total": F.when(F.col("_n") > 1, u).otherwise(t), "qty": F.when(F.col("_n") > 1, F.lit(1.0)).otherwise(q)}).drop("_n")


def event_model(items: DataFrame) -> DataFrame:
    """Per account: surgery and stay packages; anesthesia drugs imply surgery."""
    t = F.lower(F.concat_ws(" ", "section", "description"))
    anesthesia = contains_any(t, lx.ANESTHESIA_TEXT)
    known = by_text(items.select("account", "section", "description"), ["section", "description"], {"_s": contains_any(t, lx.SURGERY_TEXT), "_a": anesthesia, "_d": contains_any(t, lx.STAY_TEXT)})
    g = known.groupBy("account").agg(F.bool_or("_s").alias("_s"), F.bool_or("_a").alias("_a"), F.bool_or("_d").alias("has_stay"))
    s = F.col("_s") | F.col("_a")
    return g.select("account", s.alias("has_surgery"), "has_stay", F.when(s, "CIRUGIA_MAYOR").otherwise("HOSPITALIZACION_GENERAL").alias("act"),
                    (F.col("_a") & ~F.col("_s")).alias("inferred"))


def package_origin(members: DataFrame, model: DataFrame) -> DataFrame:
    """Package a matched set comes from: its sections, else anesthesia drugs, else the event."""
    s, d = F.lower(F.coalesce("section", F.lit(""))), normalize_strict(F.col("description"))
    g = members.groupBy("account", "line_id").agg(
        F.bool_or(contains_any(s, lx.PACKAGE_SURGERY_SECTION)).alias("surgery"), F.bool_or(s.contains("recuperacion")).alias("recovery"),
        F.bool_or(contains_any(s, lx.PACKAGE_STAY_SECTION)).alias("stay"), F.bool_or(s.contains("urgencia")).alias("urgency"),
        F.bool_or(contains_any(d, lx.PACKAGE_DRUG)).alias("drug"), F.bool_or(d.rlike("mg|ml|amp")).alias("dosed"))
    c = F.col
    origin = first_match([("DERECHO_PABELLON", c("surgery") | c("recovery")), ("DIA_CAMA_INTEGRAL", c("stay")), ("URGENCIA", c("urgency")),
                          ("DERECHO_PABELLON", c("drug") | ((c("act") == "CIRUGIA_MAYOR") & c("dosed")))], "DIA_CAMA_INTEGRAL")
    return g.join(model, "account").select("account", "line_id", origin.alias("origin"))


# -- single items ---------------------------------------------------------------

def amount_match(lines: DataFrame, items: DataFrame, on: str = "valor") -> DataFrame:
    """Lines whose amount equals an item total: OK when unique, PARTIAL when repeated, FAIL when absent.

    Items carry ``distance`` (see anchor_distance). Among repeated amounts the item nearest to an anchor
    wins, then one that fits the line's domain, then the earlier position.
    """
    fits = {"DRUG": F.col("drug"), "SUPPLY": F.col("supply")}
    pick = lambda fit: F.min(F.struct(F.isnull("distance").alias("far"), "distance", (~fit).alias("misfit"), "pos", "item_id"))
    by_amount = pools(items).groupBy("account", F.col("total").alias(on)).agg(
        F.count(F.lit(1)).alias("candidates"), pick(F.lit(True)).alias("any"), *[pick(f).alias(n) for n, f in fits.items()])
    j = lines.join(by_amount, ["account", on], "left")
    domain = K.line_domain(F.col("code"), F.col("description"))
    best = first_match([(F.col("DRUG"), domain == "DRUG"), (F.col("SUPPLY"), domain == "SUPPLY")], F.col("any"))
    n = F.coalesce("candidates", F.lit(0))
    return j.select(*lines.columns, n.alias("candidates"), first_match([("FAIL", n == 0), ("OK", n == 1)], "PARTIAL").alias("status"),
                    best["pos"].alias("pos"), best["item_id"].alias("item_id"))


def amount_or_copago_match(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Match on the full amount, else on the copago."""
    counts = items.groupBy("account", F.col("total").alias("amount")).agg(F.count(F.lit(1)).alias("n"))
    by = lambda c: counts.select("account", F.col("amount").alias(c), F.col("n").alias(f"n_{c}"))
    j = lines.join(by("valor"), ["account", "valor"], "left").join(by("copago"), ["account", "copago"], "left")
    n = F.coalesce("n_valor", F.when(F.col("copago") > 0, F.col("n_copago")))
    return j.select("account", "line_id", F.when(F.col("n_valor").isNotNull(), "TOTAL").when(n.isNotNull(), "COPAGO").alias("matched_on"),
                    first_match([("FAIL", n.isNull()), ("OK", n == 1)], "PARTIAL").alias("status"))


def consume_unique(matches: DataFrame) -> DataFrame:
    """Who takes an item that several lines claim by its unique amount: the line first in priority; the rest fail.

    Only unique matches take items, so every contest is for one item and its winner is a minimum.
    """
    rank = F.struct(K.line_priority(F.col("code")), "line_id")
    won = matches.filter("status = 'OK'").groupBy("account", "pos").agg(F.min(rank)["line_id"].alias("_winner"))
    j = matches.join(won, ["account", "pos"], "left")
    lost = (F.col("status") == "OK") & (F.col("_winner") != F.col("line_id"))
    keep = ~lost & (F.col("status") != "FAIL")
    return j.withColumns({"status": F.when(lost, "FAIL").otherwise(F.col("status")), "pos": F.when(keep, F.col("pos")),
                          "item_id": F.when(keep, F.col("item_id"))}).select(*matches.columns)


def text_match(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines whose text equals an item's: OK when unique, PARTIAL (lowest id) when repeated."""
    text = lambda df: F.col("_text") if "_text" in df.columns else normalize_strict(F.col("description"))
    by_text = items.groupBy("account", text(items).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("item_id"))
    j = lines.withColumn("text", text(lines)).join(by_text, ["account", "text"], "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("account", "line_id", n.alias("candidates"), "item_id",
                    first_match([("FAIL", (n == 0) | (F.col("text") == "")), ("OK", n == 1)], "PARTIAL").alias("status"))


def containment_match(lines: DataFrame, items: DataFrame, min_len: int = 6) -> DataFrame:
    """Shortest item text that contains the line text or is contained in it.

    Each different description is normalized once, and containment is decided once per pair of texts.
    """
    text = lambda df, name: df.select("description").distinct().select("description", normalize_strict(F.col("description")).alias(name))
    line_texts, item_texts = checkpoint(text(lines, "line_text").filter("line_text <> ''")), checkpoint(text(items, "item_text").filter(F.length("item_text") >= min_len))
    lt = lines.join(line_texts, "description").select("account", "line_id", "line_text")
    it = items.join(item_texts, "description").select("account", "item_id", "item_text")
    pairs = either_way(line_texts.select(F.col("line_text").alias("t")), item_texts.select(F.col("item_text").alias("t"))).toDF("line_text", "item_text")
    per_item_text = it.groupBy("account", "item_text").agg(F.min("item_id").alias("item_id"))
    best = per_item_text.join(pairs, "item_text").groupBy("account", "line_text").agg(
        F.min(F.struct(F.length("item_text").alias("len"), "item_id")).alias("b"))
    return lt.join(best, ["account", "line_text"]).select("account", "line_id", F.col("b.item_id").alias("item_id"), F.col("b.len").alias("length"))


# -- contiguous runs ------------------------------------------------------------

def prefix_sums(pool: DataFrame) -> DataFrame:
    """Pool items with their rank in the pool and the sum up to and before them; a pool that has them stays as it is."""
    if {"rank", "upto", "before"} <= set(pool.columns):
        return pool
    s = sequence.carry(pool, ["account"], ["pos"], sequence.by_pos(), sums={"rank": F.lit(1).cast("long"), "upto": F.col("total")})
    return s.withColumn("before", F.col("upto") - F.col("total"))


def contiguous_match(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """First run of consecutive pool items that adds up to the line exactly.

    A run from i to j adds up to v when upto(j) = before(i) + v: an equi-join on sums. Totals are not negative.
    """
    p = prefix_sums(pool.filter("total >= 0")).select("account", "pos", "rank", "upto", "before")
    whole = p.groupBy("account").agg(F.max("upto").alias("_all"))
    targets = lines.filter("valor > 0").select("account", "line_id", "valor").join(whole, "account").filter("valor <= _all")
    wanted = targets.groupBy("account", "valor", "_all").agg(F.lit(1).alias("_one"))
    starts = wanted.join(p, "account").filter(F.col("before") + F.col("valor") <= F.col("_all")).select(
        "account", "valor", F.col("rank").alias("first"), F.col("pos").alias("first_pos"), (F.col("before") + F.col("valor")).alias("upto"))
    ends = p.select("account", "upto", F.col("rank").alias("last"), F.col("pos").alias("last_pos"))
    hit = starts.join(ends, ["account", "upto"]).filter("last >= first").groupBy("account", "valor").agg(
        F.min(F.struct("first", "last", "first_pos", "last_pos")).alias("b"))
    return targets.join(hit, ["account", "valor"]).select("account", "line_id", "valor", "b.first_pos", "b.last_pos", (F.col("b.last") - F.col("b.first") + 1).alias("n"))


def contiguous_candidates(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """For every start the first run that adds up to the line within one unit. Columns: line_id, cand, first, last."""
    p = prefix_sums(pool.filter("total >= 0")).select("account", "pos", "rank", "upto", "before")
    # Items of small accounts are looked through in a row of their account, those of others meet by ranges of sums.
    item = F.when(F.col("rank") <= FEW, F.struct("rank", "upto", "before"))
    whole = p.groupBy("account").agg(F.max("upto").alias("_all"), F.greatest(F.count(F.lit(1)), F.max("rank")).alias("_n"), F.sort_array(F.collect_list(item)).alias("_items"))
    t = lines.filter("valor > 0").select("account", "line_id", "valor")
    ends = lambda s: F.filter("_items", lambda x: (x["rank"] >= s["rank"]) & (F.abs(x["upto"] - s["before"] - F.col("valor")) <= 1))
    runs = F.transform("_items", lambda s: F.struct(s["rank"].alias("first"), F.array_min(F.transform(ends(s), lambda x: x["rank"])).alias("last")))
    near = t.join(whole.filter(F.col("_n") <= FEW), "account").filter("valor <= _all + 1").select("account", "line_id", F.explode(runs).alias("r")).select("account", "line_id", "r.*").filter("last is not null")
    near = near.groupBy("account", "line_id", "first").agg(F.min("last").alias("last"))
    large = checkpoint(p.groupBy("account").agg(F.max("upto").alias("_all"), F.greatest(F.count(F.lit(1)), F.max("rank")).alias("_n")).filter(F.col("_n") > FEW).select("account", "_all"))
    if not large.isEmpty():
        near = near.unionByName(_ranged_candidates(t.join(large, "account").filter("valor <= _all + 1"), p.join(large.select("account"), "account", "left_semi")))
    return near.select("account", "line_id", F.col("first").alias("cand"), "first", "last")


def _ranged_candidates(t: DataFrame, p: DataFrame) -> DataFrame:
    """``contiguous_candidates`` in accounts of any size. t: account, line_id, valor, _all (the sum of the account's pool)."""
    # A start meets the one or two ranges of sums that the line ends in.
    range_ = lambda x: F.floor(x / RANGE).cast("long")
    starts = t.join(p, "account").filter(F.col("before") + F.col("valor") - 1 <= F.col("_all")).select(
        "account", "line_id", F.col("rank").alias("first"), (F.col("before") + F.col("valor")).alias("goal"))
    starts = starts.withColumn("_r", F.explode(F.array_distinct(F.array(range_(F.col("goal") - 1), range_(F.col("goal") + 1)))))
    ends = p.groupBy("account", "upto").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).withColumn("_r", range_(F.col("upto")))
    hit = starts.join(ends, ["account", "_r"]).filter((F.abs(F.col("upto") - F.col("goal")) <= 1) & (F.col("hi") >= F.col("first")))
    return hit.groupBy("account", "line_id", "first").agg(F.min(F.greatest("lo", "first")).alias("last"))


def run_members(candidates: DataFrame, pool: DataFrame) -> DataFrame:
    """Items of each candidate run, with k their rank in the pool."""
    p = prefix_sums(marked(pool.filter("total >= 0"))).withColumnRenamed("rank", "k").drop("upto", "before")
    return candidates.select("account", "line_id", "cand", F.explode(F.sequence("first", "last")).alias("k")).join(p, ["account", "k"])


def longest_run(members: DataFrame) -> DataFrame:
    """Longest run of adjacent positions per candidate; k ranks the members, so adjacent ones share pos - k."""
    runs = members.groupBy("line_id", "cand", (F.col("pos") - F.col("k")).alias("_run")).agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("line_id", "cand").agg(F.max("n").alias("run"), F.sum("n").alias("size"))


def marked(items: DataFrame) -> DataFrame:
    """Items with what the score of a set asks of their texts; items that have it stay as they are."""
    if "_section" in items.columns:
        return items
    section, d = normalize_strict(F.col("section")), normalize_strict(F.col("description"))
    # Comfort words of the affinity bonus.
    comfort = ["calzon", "aseo", "termometro", "delantal", "mangas", "medias", "confort", "lubricante", "removedor", "adhesivo"]
    return by_text(items, ["section", "description"], {"_section": section, "_pavilion": section.rlike("pabellon|quirurgico"), "_comfort": contains_any(d, comfort),
                                                       "_clinical": contains_any(d, lx.CLINICAL_WORDS)})


def score_candidates(members: DataFrame, lines: DataFrame, boost: int = 0, pure: bool = False) -> DataFrame:
    """Score of each candidate set: contiguity, sections, mixing, size, comfort affinity, numeric confidence.

    With ``pure`` each clinical item takes 50 from a set of a catch-all line.
    """
    # A set's rows meet once, for its runs and for the set.
    m = marked(members).repartition("account", "line_id", "cand")
    # Runs first: adjacent positions share pos - k. The facts of a set's runs add up to the set's.
    runs = m.groupBy("account", "line_id", "cand", (F.col("pos") - F.col("k")).alias("_run")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("_section").alias("sections"), F.bool_or("_pavilion").alias("pavilion"),
        F.count_if("_comfort").alias("comfort"), F.sum("total").alias("sum"), F.count_if("_clinical").alias("clinical"))
    facts = runs.groupBy("account", "line_id", "cand").agg(
        F.max("n").alias("run"), F.sum("n").alias("size"), F.size(F.array_distinct(F.flatten(F.collect_list("sections")))).cast("long").alias("sections"),
        F.bool_or("pavilion").alias("pavilion"), F.sum("comfort").alias("comfort"), F.sum("sum").alias("sum"), F.sum("clinical").alias("clinical"))
    c = F.col
    j = facts.join(lines.select("line_id", "code", "description", "valor", "bonif", "copago"), "line_id")
    pool = c("code").startswith("310")
    stay = normalize_strict(c("description")).rlike("dia cama|hospitalizacion")
    exact = F.least(F.abs(c("sum") - c("copago")), F.abs(c("sum") - c("bonif")), F.abs(c("sum") - c("copago") - c("bonif"))) < 2
    on = lambda p, v: F.when(p, v).otherwise(0)
    score = (on(c("run") > 1, c("run") * 5) + on(c("run") == c("size"), 10) + on(~pool & (c("sections") == 1), 50)
             - on(~pool & (c("sections") > 1), (c("sections") - 1) * 15) - on(stay & c("pavilion") & ~pool, 80)
             - on(c("size") > 8, (c("size") - 8) * 2) + on(c("code").isin(lx.NOT_COVERED_CODES) & (c("comfort") * 2 >= c("size")), 30)
             + on(pool & exact, 40) + boost)
    if pure:
        score = score - on(c("code").startswith("320"), c("clinical") * 50)
    return j.select("account", "line_id", "cand", "size", "run", "sections", score.cast("long").alias("score"))


def ranked_candidates(scored: DataFrame, k: int = 5) -> DataFrame:
    """Best k candidates per line; the earlier one on equal scores."""
    return sequence.best(scored, ["line_id"], [F.desc("score"), F.col("cand")], k, rank="n")


# -- blocks and combinations ----------------------------------------------------

def section_blocks(items: DataFrame) -> DataFrame:
    """Total per (inferred) section of the account."""
    g = items.groupBy("account", K.virtual_section(F.col("section"), F.col("description")).alias("block")).agg(
        F.sum("total").alias("amount"), F.count(F.lit(1)).alias("items"))
    return g.filter("amount > 0")


def block_match(lines: DataFrame, blocks: DataFrame, tolerance: int = 2) -> DataFrame:
    """Blocks whose total is less than ``tolerance`` away from the line: neighbouring buckets meet, then the exact test."""
    b = F.floor(F.col("amount") / tolerance)
    near = blocks.select("account", "block", "amount", F.explode(F.array(b - 1, b, b + 1)).alias("_b"))
    t = lines.select("account", "line_id", "valor", F.floor(F.col("valor") / tolerance).alias("_b"))
    return t.join(near, ["account", "_b"]).filter(F.abs(F.col("amount") - F.col("valor")) < tolerance).select("account", "line_id", "block", "amount")


def block_combinations(lines: DataFrame, blocks: DataFrame, k: int = 3, tolerance: int = 2) -> DataFrame:
    """First combination of up to k distinct blocks adding up to the line; a partial sum above the line is dropped at once.

    Blocks are the sections of one account, a handful of rows. The last block is found by its amount.
    """
    # A row per account: every size meets the blocks where they are.
    known = F.filter(F.collect_list(F.struct("block", "amount")), lambda x: x["block"].isNotNull() & x["amount"].isNotNull())
    b = blocks.groupBy("account").agg(known.alias("blocks"))
    part = lines.filter("valor > 0").select("account", "line_id", "valor", F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("parts"),
                                            F.lit("").alias("last")).join(b, "account")
    hits = lambda size: F.transform(F.filter("blocks", lambda x: (x["block"] > F.col("last")) & (F.abs(F.col("valor") - F.col("sum") - x["amount"]) < tolerance)),
                                    lambda x: F.struct(F.concat("parts", F.array(x["block"])).alias("parts"), F.lit(size).alias("k")))
    on = F.filter("blocks", lambda x: (x["block"] > F.col("last")) & (F.col("sum") + x["amount"] < F.col("valor")))
    part = part.withColumn("b", F.array_min(hits(1)))
    for size in range(2, k + 1):
        # Without a block to go on with a row stays for what it has found.
        part = part.withColumn("_x", F.explode_outer(on)).withColumns({"sum": F.col("sum") + F.col("_x.amount"), "parts": F.concat("parts", F.array("_x.block")), "last": F.col("_x.block")})
        part = part.withColumn("b", F.least("b", F.array_min(hits(size))))
    return part.groupBy("account", "line_id").agg(F.min("b").alias("b")).filter("b is not null").select("account", "line_id", "b.parts", "b.k")


def pair_match(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """First two pool items that add up to the line: the second is found by the amount that is missing."""
    amounts = pool.filter("total > 0").groupBy("account", "total").agg(F.min("pos").alias("p1"), F.count(F.lit(1)).alias("n"), F.max("pos").alias("p2"))
    want = lines.filter("valor > 0").select("account", "valor").distinct()
    firsts = want.join(amounts, "account").filter(F.col("total") * 2 <= F.col("valor")).select(
        "account", "valor", F.col("total").alias("a"), "p1", "p2", "n", (F.col("valor") - F.col("total")).alias("total"))
    seconds = amounts.select("account", "total", F.col("p1").alias("q1"))
    j = firsts.join(seconds, ["account", "total"]).filter((F.col("a") != F.col("total")) | (F.col("n") > 1))
    same = F.col("a") == F.col("total")
    pick = F.struct(F.col("a"), F.col("p1").alias("pos_a"), F.when(same, F.col("p2")).otherwise(F.col("q1")).alias("pos_b"))
    best = j.groupBy("account", "valor").agg(F.min(pick).alias("b"))
    return lines.select("account", "line_id", "valor").join(best, ["account", "valor"]).select("account", "line_id", "valor", "b.pos_a", "b.pos_b")


def combination_match(lines: DataFrame, items: DataFrame, domain: bool = False, units: int | None = 20) -> DataFrame:
    """Best-scored subset that adds up to each line: account, line_id, cand (its order), score, status and its rows (pos, total).

    Items of several units come as units (where ``items`` has qty and unit_price), those of more than ``units`` as a whole: so the
    operation is defined; None takes every unit. The subsets of three orders are scored; the
    first of equal scores stays. With ``domain`` a drug or supply line sees its own items only; drugs and supplies never
    enter a catch-all line. OK: within the domain and at least 50; AMBIGUOUS: below 20.
    """
    rows = unit_items(items, units) if {"qty", "unit_price"} <= set(items.columns) else items.withColumn("unit", F.lit(1))
    p = pools(rows).select("account", "pos", "unit", "total", (F.col("_section") if "_section" in rows.columns else normalize_strict(F.col("section"))).alias("section_key"), "drug", "supply")
    k = lines.filter("valor > 0").select("account", "line_id", "valor", "code", K.line_domain(F.col("code"), F.col("description")).alias("domain"))
    c = F.col
    fits = [(~c("drug") & ~c("supply"), c("domain") == "CATCH_ALL")] + ([(c("drug"), c("domain") == "DRUG"), (c("supply"), c("domain") == "SUPPLY")] if domain else [])
    open_ = k.join(p, "account").filter(first_match(fits, F.lit(True)) & (c("total") > 0) & (c("total") <= c("valor")))
    # Three orders at once: as printed, by section, largest first.
    orders = F.array(*[F.struct(F.lit(n).alias("cand"), s.alias("s"), t.alias("t")) for n, (s, t) in enumerate(
        [(F.lit(""), F.lit(0).cast("long")), (c("section_key"), F.lit(0).cast("long")), (F.lit(""), -c("total"))])])
    each = open_.select("account", "line_id", "valor", "pos", "unit", "total", F.explode(orders).alias("v"))
    each = each.select("account", F.struct("line_id", "v.cand").alias("line_id"), "valor", "pos", "unit", "total", "v.s", "v.t")
    found = checkpoint(_first_of_equal(subset_of(each, [c("s"), c("t"), c("pos"), c("unit")]).select("account", "line_id.line_id", "pos", "total", "line_id.cand"), 3))
    known = [x for x in items.columns if x in MARKS]
    members = found.join(marked(items.select("account", "pos", "section", "description", *known)), ["account", "pos"])
    # A subset's rows in order; its adjacent positions share pos - k.
    members = members.withColumn("k", F.row_number().over(Window.partitionBy("account", "line_id", "cand").orderBy("pos")))
    best = sequence.best(score_candidates(members, lines, pure=True), ["line_id"], [F.desc("score"), F.col("cand")])
    status = first_match([("OK", F.lit(domain) & (c("score") >= 50)), ("AMBIGUOUS", c("score") < 20)], "PARTIAL")
    return found.join(best.select("account", "line_id", "cand", "score", status.alias("status")), ["account", "line_id", "cand"])


def _first_of_equal(found: DataFrame, orders: int) -> DataFrame:
    """Subsets (account, line_id, cand, pos, total) that no earlier order of the line has: equal ones score the same, and the first stays."""
    row = Window.partitionBy("account", "line_id", "pos", "total")
    line = Window.partitionBy("account", "line_id")
    counted = found.repartition("account", "line_id").withColumns({f"_n{i}": F.count(F.when(F.col("cand") == i, 1)).over(row) for i in range(orders)})
    pairs = [(i, j) for j in range(orders) for i in range(j)]
    same = counted.withColumns({f"_e{i}{j}": F.min((F.col(f"_n{i}") == F.col(f"_n{j}")).cast("int")).over(line) == 1 for i, j in pairs})
    again = reduce(or_, [(F.col("cand") == j) & F.col(f"_e{i}{j}") for i, j in pairs])
    return same.filter(~again).select(*found.columns)


def bundle_anchors(pool: DataFrame) -> DataFrame:
    """account, chosen: the largest item per bundle word; an item serves one word."""
    words = let(normalize_strict(F.col("description")), lambda d: F.array(*[F.when(d.contains(w), F.struct(F.lit(i).alias("w"))) for i, w in enumerate(lx.BUNDLE_WORDS)]))
    worded = by_text(pool.select("account", "pos", "total", "description"), ["description"], {"_words": F.array_compact(words)}).filter(F.size("_words") > 0)
    per_word = worded.select("account", "pos", "total", F.explode("_words").alias("w")).select("account", "pos", "total", F.col("w.w").alias("w"))
    n = len(lx.BUNDLE_WORDS)
    top = sequence.best(per_word, ["account", "w"], [F.desc("total"), F.col("pos")], n, rank="n")
    by_word = top.groupBy("account", "w").agg(F.sort_array(F.collect_list(F.struct("n", "pos", "total"))).alias("c"))
    words_in_order = by_word.groupBy("account").agg(F.sort_array(F.collect_list(F.struct("w", "c"))).alias("ws"))
    chosen = F.aggregate(
        "ws", F.array().cast("array<struct<pos:bigint,total:bigint>>"),
        lambda acc, w: F.concat(acc, F.slice(F.transform(F.filter(w["c"], lambda x: ~F.array_contains(F.transform(acc, lambda a: a["pos"]), x["pos"])),
                                                         lambda x: F.struct(x["pos"].cast("long").alias("pos"), x["total"].alias("total"))), 1, 1)))
    return words_in_order.select("account", chosen.alias("chosen"))


def anchored_bundle(lines: DataFrame, pool: DataFrame) -> DataFrame:
    """Largest item per bundle word (an item serves one word); what the bundle leaves open of the line."""
    b = bundle_anchors(pool)
    sums = b.select("account", F.size("chosen").alias("n"), F.aggregate("chosen", F.lit(0).cast("long"), lambda a, x: a + x["total"]).alias("sum"))
    return lines.select("account", "line_id", "valor").join(sums, "account").withColumn("gap", F.col("valor") - F.col("sum"))


def filled_bundle(lines: DataFrame, pool: DataFrame, least: int = lx.BUNDLE_LEAST) -> DataFrame:
    """Bundles with up to four more items that close the gap: account, line_id, valor, n, sum, fill (positions), status.

    Of the items that are no anchors, largest first, the combination that comes first in that order fills the gap. Sums of
    two are a table of pairs; three and four are a pair that meets an item or a pair of the missing sum, both behind it: a pair
    is open to that while it stands before the last such item or pair. OK: three members and no gap of two or more.
    """
    anchors = checkpoint(bundle_anchors(pool))
    wanted = lines.filter((F.abs(F.col("valor") - lx.BUNDLE_AMOUNT) < 5) | (F.col("code").startswith("320") & (F.col("valor") > least)))
    sums = anchors.select("account", F.size("chosen").alias("n"), F.aggregate("chosen", F.lit(0).cast("long"), lambda a, x: a + x["total"]).alias("sum"))
    base = checkpoint(wanted.select("account", "line_id", "valor").join(sums, "account").withColumn("gap", F.col("valor") - F.col("sum")))
    gaps = base.filter("gap > 0")
    used = anchors.select("account", F.explode("chosen.pos").alias("pos"))
    most = gaps.groupBy("account").agg(F.max("gap").alias("_most"))
    rest = pool.select("account", "pos", "total").join(used, ["account", "pos"], "left_anti").join(most, "account").filter("total > 0 and total <= _most")
    # A fifth copy of an amount never comes in.
    copies = F.row_number().over(Window.partitionBy("account", "total").orderBy("pos"))
    one = checkpoint(rest.withColumn("_c", copies).filter("_c <= 4").select("account", "total", F.struct((-F.col("total")).alias("d"), "pos").alias("i"), "_most"))
    two = one.alias("a").join(one.alias("b"), "account").filter("a.i < b.i and a.total + b.total <= a._most")
    two = checkpoint(two.select("account", F.expr("a.total + b.total").alias("total"), F.col("a.i").alias("i"), F.col("b.i").alias("j")))
    behind = one.select("account", "total", "i").unionByName(two.select("account", "total", "i")).groupBy("account", "total").agg(F.max("i").alias("last"))
    asked = gaps.select("account", "line_id", "gap")
    whole = asked.withColumnRenamed("gap", "total")
    exact = whole.join(one.select("account", "total", F.array("i").alias("fill")), ["account", "total"]).unionByName(
        whole.join(two.select("account", "total", F.array("i", "j").alias("fill")), ["account", "total"]))
    halves = asked.join(two.select("account", F.col("total").alias("half")).distinct(), "account").filter("half < gap").withColumn("total", F.col("gap") - F.col("half"))
    open_ = halves.join(behind, ["account", "total"]).select("account", "line_id", "half", F.col("total").alias("need"), "last")
    first = open_.join(two.withColumnRenamed("total", "half"), ["account", "half"]).filter("j < last").groupBy("account", "line_id").agg(F.min(F.struct("i", "j", "need")).alias("f"))
    first = checkpoint(first.select("account", "line_id", "f.i", "f.j", F.col("f.need").alias("total")))
    ends = one.select("account", "total", F.col("i").alias("e"), F.array("i").alias("tail")).unionByName(two.select("account", "total", F.col("i").alias("e"), F.array("i", "j").alias("tail")))
    longer = first.join(ends, ["account", "total"]).filter("e > j").select("account", "line_id", F.concat(F.array("i", "j"), "tail").alias("fill"))
    best = exact.select("account", "line_id", "fill").unionByName(longer).groupBy("account", "line_id").agg(F.min("fill").alias("fill"))
    j = base.join(best, ["account", "line_id"], "left")
    fill = F.coalesce(F.col("fill.pos"), F.array().cast("array<long>"))
    closes = F.when(F.col("fill").isNotNull(), 0).otherwise(F.abs("gap"))
    ok = (F.col("n") + F.size(fill) >= 3) & (closes < 2)
    return j.select("account", "line_id", "valor", "n", (F.col("sum") + F.when(F.col("fill").isNotNull(), F.col("gap")).otherwise(0)).alias("sum"), fill.alias("fill"),
                    F.when(ok, "OK").otherwise("FAIL").alias("status"))


def pools(items: DataFrame) -> DataFrame:
    """Which pools an item belongs to: drug, supply, amenity, unspecific; items that say so stay as they are."""
    if {"drug", "supply", "amenity", "unspecific"} <= set(items.columns):
        return items
    s, d = F.col("section"), F.col("description")
    drug, supply = K.is_drug(s, d), K.is_supply(s, d)
    return by_text(items, ["section", "description"], {"drug": drug, "supply": supply, "amenity": contains_any(normalize_strict(d), lx.AMENITY), "unspecific": ~drug & ~supply})


def pool_for(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Items open to each line: its domain's, amenities for not-covered lines, else all."""
    p = pools(items).select("account", "pos", "total", "drug", "supply", "amenity")
    k = lines.select("account", "line_id", "valor", K.line_domain(F.col("code"), F.col("description")).alias("domain"))
    c = F.col
    open_ = first_match([(c("drug"), c("domain") == "DRUG"), (c("supply"), c("domain") == "SUPPLY"), (c("amenity"), c("domain") == "CATCH_ALL")], F.lit(True))
    return k.join(p, "account").filter(open_ & (c("total") <= c("valor")))


# -- running subtotals ----------------------------------------------------------

def closed_items(items: DataFrame, tolerance: int = 2, rows: int = sequence.CHUNK) -> DataFrame:
    """account, pos, closer_pos: the items that each closing item takes.

    In order, an item equal to the sum of the open items just before it (the fewest that add up to it) closes them: they
    are no longer open, and it never is. Accounts are cut into chunks of ``rows`` items; a round runs the next chunk of every
    account on top of the open items it can reach, so there are as many rounds as chunks in the longest account.
    """
    left = items.filter("total > 0").select("account", "pos", "total")
    ranked = checkpoint(sequence.number(left, ["account"], ["pos"], sequence.by_pos(), name="_n").withColumn("_k", F.floor((F.col("_n") - 1) / rows)))
    last = ranked.agg(F.max("_k")).first()[0]
    closed = below = None
    for k in range((last if last is not None else -1) + 1):
        chunk = ranked.filter(F.col("_k") == k).select("account", "pos", "total")
        runs = chunk.withColumn("fresh", F.lit(True))
        if below is not None:
            reach = chunk.groupBy("account").agg(F.max("total").alias("_most"))
            above = sequence.carry(below.withColumn("_back", -F.col("pos")), ["account"], ["_back"], F.floor(F.col("_back") / rows).cast("long"), sums={"_sum": F.col("total")})
            near = above.join(reach, "account").filter(F.col("_sum") < F.col("_most") + tolerance)
            runs = runs.unionByName(near.select("account", "pos", "total", F.lit(False).alias("fresh")))
        done = checkpoint(_close(runs.repartition("account").sortWithinPartitions("account", "pos"), tolerance))
        closed = done if closed is None else closed.unionByName(done)
        if k < last:
            gone = done.select("account", "pos").union(done.select("account", "closer_pos")).distinct()
            open_ = chunk if below is None else below.unionByName(chunk)
            below = checkpoint(open_.join(gone, ["account", "pos"], "left_anti").join(ranked.filter(F.col("_k") > k).select("account").distinct(), "account", "left_semi"))
    return left.select("account", "pos", F.col("pos").alias("closer_pos")).limit(0) if closed is None else closed


def _close(runs: DataFrame, tolerance: int) -> DataFrame:
    """Stack of open items along account and position; rows that are not ``fresh`` lie open from the start."""

    def run(batches):
        account, stack, sums = None, [], [0]
        for b in batches:
            out: list[list] = [[], [], []]
            for a, p, v, fresh in zip(*(c.to_pylist() for c in b.columns)):
                if a != account:
                    account, stack, sums = a, [], [0]
                # sums[j] is what lies below item j: the fewest items are the greatest j.
                j = bisect_right(sums, sums[-1] - v + tolerance - 1, 0, len(stack)) - 1 if fresh else -1
                if j >= 0 and sums[-1] - sums[j] < v + tolerance:
                    out[0] += [a] * (len(stack) - j)
                    out[1] += stack[j:]
                    out[2] += [p] * (len(stack) - j)
                    del stack[j:], sums[j + 1 :]
                else:
                    stack.append(p)
                    sums.append(sums[-1] + v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, (b.schema.field(0), b.schema.field(1), b.schema.field(1)))], names=["account", "pos", "closer_pos"])

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    return runs.select("account", "pos", "total", "fresh").mapInArrow(run, f"account {kinds['account']}, pos {kinds['pos']}, closer_pos {kinds['pos']}")


def running_subtotals(items: DataFrame, tolerance: int = 2) -> DataFrame:
    """Items that equal the sum of the (two or more) open items just before them and close them."""
    g = closed_items(items, tolerance).groupBy("account", "closer_pos").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos")).filter("n > 1")
    closers = items.select("account", F.col("pos").alias("closer_pos"), "item_id", F.col("total").alias("amount"))
    return g.join(closers, ["account", "closer_pos"]).select("account", "item_id", "amount", "first_pos", "closer_pos", "n")


# -- trace ----------------------------------------------------------------------

ORDER = {"OK": 1, "AMBIGUOUS": 2, "PARTIAL": 3, "FAIL": 4}


def trace_summary(attempts: DataFrame) -> DataFrame:
    """Best status over the attempts of a line and its traceability level."""
    c = F.col
    ok = c("status") == "OK"
    rank = first_match([(v, c("status") == k) for k, v in ORDER.items()], 4)
    strong = (ok & c("step").isin("MONTO_1A1", "GLOSA_FAMILIA")) | (ok & (c("step") == "MONTO_CONTIGUO") & (c("score") >= 80)) | (
        ok & (c("step") == "SUBTOTAL") & c("explicit")) | ((c("step") == "MONTO_SUBSET") & c("status").isin("OK", "PARTIAL") & c("domain_pool") & (c("score") >= 50))
    g = attempts.groupBy("account", "line_id").agg(F.min(rank).alias("r"), F.bool_or(strong).alias("strong"), F.bool_or(c("matched") > 0).alias("some"))
    return g.select("account", "line_id", first_match([(k, c("r") == v) for k, v in ORDER.items()], "FAIL").alias("status"),
                    first_match([("TRACE_OK", c("strong")), ("TRACE_WEAK", c("some"))], "TRACE_NONE").alias("level"))


def ordered_strategies(lines: DataFrame, strategies: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Run strategies in order, each on the lines the earlier ones left; returns (account, line_id, step, ...)."""
    left, out = lines, None
    for name, run in strategies:
        hit = checkpoint(run(left).withColumn("step", F.lit(name)))
        out = hit if out is None else out.unionByName(hit, allowMissingColumns=True)
        left = left.join(hit.select("line_id").distinct(), "line_id", "left_anti")
    return out
