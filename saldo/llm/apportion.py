"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks.

A source's documents are dealt into shards by a seeded hash of doc_id and text and laid end to end there; every ``block`` words are a block. The mix's blocks go
to the sources one by one by the highest quotient target / (2 k + 1), where k is what a source has; a source's blocks go to its shards
the same way by the shard's words. Both are settled at once from the ordered quotients. Inside a shard whole rounds take every word,
and a seeded order of blocks says which are taken once more; a last block is cut where the source's target ends.

Null texts have size 0 and are never taken. A null source is a source of its own, last in order. Rows that repeat a doc_id are documents of
their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import BROADCAST_BYTES, hidden, place, words
from saldo.session import checkpoint

#: Words in a block.
BLOCK = 256
#: Words of a shard, about.
SHARD_WORDS = 1 << 20
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of every source: ``share`` of all words by weight; what is above ``cap`` times a source goes to the others.

    A source is above its cap if its size for a unit of weight is below the level at which the words given out match; levels are
    tried at each source's own border. One row a source takes part.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")  # one row a source
    s = s.withColumn("no", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("top", F.col("source_size") * F.lit(float(cap))).withColumn("level", F.col("top") / F.col("weight"))
    s = s.withColumn("at", F.row_number().over(Window.orderBy("level", "no")))
    s = s.withColumn("below", F.coalesce(F.sum("top").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(Window.orderBy("at").rowsBetween(0, Window.unboundedFollowing)))
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("line", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("below")) / F.col("open"))
    # The first source, by level, that the line of all from it on does not fill sets the line.
    line = F.min(F.when(F.col("level") >= F.col("line"), F.struct("at", "line"))).over(whole)
    return s.withColumn("line", line["line"]).select("source", "source_size", F.least("top", F.coalesce(F.col("line") * F.col("weight"), "top")).alias("target"))


def apportioned(votes: DataFrame, group: list[str], order: list) -> DataFrame:
    """Sainte-Lague: column ``seats`` of each ``group`` is given to its rows by column ``votes``; adds ``quota``.

    The divisor that fits lies between votes / (seats + n / 2) and votes / (seats - n / 2) for n rows, so each row surely has the seats of
    the largest one and competes with few quotients more: two a row on average. Ties go to the first by ``order``.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col("votes") / F.sum("votes").over(w)
    half = F.count("*").over(w) / 2
    v = votes.where("votes > 0").withColumn("_sure", F.greatest(F.ceil(share * (F.col("seats") - half) - 0.5), F.lit(0)).cast("long"))
    v = v.withColumn("_most", F.greatest(F.floor(share * (F.col("seats") + half) + 0.5), F.col("_sure")).cast("long"))
    v = v.withColumn("_left", F.col("seats") - F.sum("_sure").over(w))
    q = v.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most"))))
    q = q.withColumn("_rank", F.row_number().over(w.orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc(), *order, "_k")))
    mine = [c for c in votes.columns]
    won = F.sum((F.col("_rank") <= F.col("_left")).cast("long"))
    return q.groupBy(*mine, "_sure").agg(won.alias("_won")).select(*mine, (F.col("_sure") + F.col("_won")).alias("quota"))


def number(*of: Column) -> Column:
    """A seeded 32-bit number of some values, the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("?")) for x in of])), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words of the document that the mix takes, repeats counted) of every row."""
    return chosen(docs, **how).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with all their columns and taken; an older column taken is replaced."""
    of = chosen(docs, **how)
    same = Window.partitionBy("doc_id", "source", "of")  # copies of one row share a number's words in any order
    of = of.withColumn("_c", F.row_number().over(same.orderBy("taken"))).where("taken > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("of").alias("_h"), "_c", "taken")
    doc_id, source, text = (f"c{place(docs, c)}" for c in ("doc_id", "source", "text"))
    mine = hidden(docs).withColumn("_source", F.col(source).cast("string")).withColumn("_of", F.xxhash64(text))
    mine = mine.withColumn("_copy", F.row_number().over(Window.partitionBy(doc_id, "_source", "_of").orderBy(F.lit(0))))
    on = F.col(doc_id).eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_of") == F.col("_h")) & (F.col("_copy") == F.col("_c"))
    kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns) if c.lower() != "taken"]
    return mine.join(of, on).select(*kept, "taken")


def chosen(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 7) -> DataFrame:
    """doc_id, source, of (a hash of the text), size, source_size, target and taken of every row."""
    sizes = checkpoint(docs.select("doc_id", F.col("source").cast("string"), F.xxhash64("text").alias("of"), F.size(words(F.col("text"))).cast("long").alias("size")))
    of = targets(sizes, share, cap, weights)
    of = of.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    total = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long")
    of = checkpoint(of.select(*of.columns, F.col("target").alias("votes"), total.alias("seats")))
    won = apportioned(of, [], [F.col("source").isNull(), "source"]).select(F.col("source").alias("_s"), F.col("quota"))
    of = checkpoint(of.join(won, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "shards", F.coalesce("quota", F.lit(0)).alias("quota")))
    bytes_ = of.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    few = bytes_ <= BROADCAST_BYTES  # else the join is a shuffle, whose hot keys Spark splits
    to = of.select(F.col("source").alias("_s"), "source_size", "target", "shards")
    d = sizes.join(F.broadcast(to) if few else to, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("shard", F.pmod(number(F.lit(seed), F.col("doc_id"), F.col("of")), F.col("shards")))
    line = Window.partitionBy("source", "shard").orderBy("turn", "doc_id", "of", "size")
    d = d.withColumn("turn", number(F.lit(seed + 1), F.col("doc_id"), F.col("of")))
    d = checkpoint(d.withColumn("hi", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("size")).withColumn("row", F.row_number().over(line)))

    # Blocks of each shard, by Sainte-Lague; what a source's target has besides goes to its largest shard.
    s = d.groupBy("source", "shard").agg(F.sum("size").alias("votes"))
    s = s.join(of.select(F.col("source").alias("_s"), F.col("quota").alias("seats"), F.round("target").cast("long").alias("goal")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    s = apportioned(s, ["source"], ["shard"])
    mine = Window.partitionBy("source")
    rest = F.col("goal") - F.col("seats") * block
    s = s.withColumn("words", F.col("quota") * block + F.when(F.row_number().over(mine.orderBy(F.col("votes").desc(), "shard")) == 1, rest).otherwise(0))
    s = s.withColumn("words", F.least(F.greatest("words", F.lit(0)), (F.col("votes") * cap).cast("long")))
    s = checkpoint(s.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), F.floor(F.col("words") / F.col("votes")).alias("rounds"), F.pmod("words", "votes").alias("more"), F.col("votes").alias("_n")))

    # A seeded order of each shard's blocks: the first ``more`` words in it are taken once more.
    b = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block))).alias("_b"))
    ahead = Window.partitionBy("_s", "_h").orderBy(number(F.lit(seed + 2), F.col("_s"), F.col("_h"), F.col("_b")), "_b").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.lit(block), F.col("_n") - F.col("_b") * block)
    b = b.withColumn("room", F.greatest(F.col("more") - F.coalesce(F.sum(size).over(ahead), F.lit(0)), F.lit(0))).where("room > 0").select("_s", "_h", "_b", "room")
    part = d.where("size > 0").select("source", "shard", "row", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("block"))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))
    part = part.join(b, on & (F.col("block") == F.col("_b")))
    start = F.greatest(F.col("lo"), F.col("block") * block)
    size = F.least(F.col("hi"), (F.col("block") + 1) * block) - start
    part = part.groupBy("source", "shard", "row").agg(F.sum(F.least(F.greatest(F.col("room") - (start - F.col("block") * block), F.lit(0)), size)).alias("extra"))
    part = part.select(F.col("source").alias("_t"), F.col("shard").alias("_k"), F.col("row").alias("_r"), "extra")
    d = d.join(part, F.col("source").eqNullSafe(F.col("_t")) & (F.col("shard") == F.col("_k")) & (F.col("row") == F.col("_r")), "left")
    d = d.join(s, on, "left")
    taken = F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return d.select("doc_id", "source", "of", "size", "source_size", "target", taken.cast("long").alias("taken"))
