"""Benchmark decontamination with a positional inverted index.

One pass cuts all texts into words and writes the positional postings (row, term, pos) of every training token that is a test term. From them come
the terms' counts, hence the rarest terms of each test window. The lists of the two rarest terms that occur are shifted by the term's offset
in the window to the window's start and intersected on (row, window, start); what the two share is intersected with the lists of all other terms, at
the places still asked for. Lists of frequent terms are never shifted whole.

A phrase match has every word of the window in its place. A proximity match has at least four fifths of them, the two rarest terms that occur
among them, each at most ``slop`` words from its place: a passage with single words replaced, put in or left out is still found. Phrase
matches are proximity matches too.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Null and empty texts have no words and no hits. An item of fewer words
than a window is one window; an item without words is ignored. Items that repeat an item_id count once; items without an id hit, but
are not counted. Rows are told apart by a number, so rows that share a doc_id, or have none, are judged each for itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import BROADCAST_BYTES, fold, shipped, words, written
from saldo.session import checkpoint

#: Words before A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words that a term of a proximity match may stand away from its place.
SLOP = 2
#: Number of the empty term, whose one posting of a row stands behind the last word.
END = -1


def test_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, terms and size of each ``width``-word window of the items; equal windows of an item are one."""
    w = F.transform(words(F.col("text"), TERM), fold)
    of = items.select("item_id", w.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - width, F.lit(0))
    of = of.select("item_id", "w", F.explode(F.sequence(F.lit(1), last + 1)).alias("i"))
    of = of.select("item_id", F.slice("w", F.col("i"), F.lit(width)).alias("terms")).distinct()
    return of.select("item_id", "terms", F.size("terms").alias("size"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, term, pos), pos from 1, of the words of all texts that are among ``terms`` (word, term); the posting of ``END`` also has the doc_id."""
    at = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(words(F.col("text"), TERM), F.array(F.lit(""))).alias("w"))
    at = at.select("row", "doc_id", F.posexplode("w").alias("p", "t")).select("row", "doc_id", (F.col("p") + 1).alias("pos"), fold(F.col("t")).alias("word"))
    size = terms.agg(F.sum(F.octet_length("word") + 40)).first()[0]
    at = at.join(F.broadcast(terms) if size <= BROADCAST_BYTES else terms, "word")
    return at.select("row", "term", "pos", F.when(F.col("term") == END, F.col("doc_id")).alias("doc_id"))


class Index:
    """Windows of a test set and the postings of their terms.

    ``items``: item_id, window; ``places``: window, size, offset, term of every word of a window; ``rarest``: window, offset, term, lists (bits: 1 for the
    rarest list, 2 for the second; 3 where the window has one word); ``stored``: row, term, pos, and doc_id where term is ``END``.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, width: int):
        if not 1 <= width <= 62:
            raise ValueError("a window has 1 to 62 words")
        found = checkpoint(test_windows(items, width))
        windows = checkpoint(found.select("terms", "size").distinct().withColumn("window", F.monotonically_increasing_id()))
        self.items = checkpoint(found.join(windows.drop("size"), "terms").select("item_id", "window"))
        at = windows.select("window", "size", F.posexplode("terms").alias("offset", "word"))
        terms = checkpoint(at.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
        ends = docs.sparkSession.createDataFrame([("", END)], "word string, term long")
        self.stored = written(postings(docs, checkpoint(terms.unionByName(ends))), "postings")
        counts = self.stored.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("n"))
        at = checkpoint(at.join(terms, "word").join(counts, "term", "left"))
        self.places = at.select("window", "size", "offset", "term")
        by = F.array_sort(F.collect_list(F.struct("n", "word", "offset", "term")))  # ``width`` terms at most
        two = at.where("n > 0").groupBy("window", "size").agg(F.slice(by, 1, 2).alias("by")).where(F.size("by") == F.least(F.lit(2), F.col("size")))
        two = two.select("window", "size", F.posexplode("by").alias("rank", "x"))
        lists = F.when(F.col("size") == 1, F.lit(3)).otherwise(F.col("rank") + 1)
        self.rarest = checkpoint(two.select("window", "x.offset", "x.term", lists.alias("lists")))

    def rows(self) -> DataFrame:
        """row, doc_id and n_words of every row."""
        return self.stored.where(F.col("term") == END).select("row", "doc_id", (F.col("pos") - 1).cast("long").alias("n_words"))


def shifts(lists, slop: int):
    """Array of -slop to slop for the second list, 0 alone for the rarest."""
    return F.when(lists == 2, F.sequence(F.lit(-slop), F.lit(slop))).otherwise(F.array(F.lit(0)))


def matches(index: Index, slop: int = SLOP) -> DataFrame:
    """row, window, start, size, exact: phrase matches (exact) and proximity matches; start (words from 1) is where the rarest term puts the window."""
    p = index.stored.where(F.col("term") != END).join(shipped(index.rarest, 60), "term")
    p = p.select("row", "window", "lists", (F.col("pos") - F.col("offset")).alias("at"), F.explode(shifts(F.col("lists"), slop)).alias("shift"))
    met = p.groupBy("row", "window", (F.col("at") + F.col("shift")).alias("start")).agg(F.bit_or("lists").alias("lists"))
    met = checkpoint(met.where("lists = 3").select("row", "window", "start"))
    # The other lists, at the places that the first two leave.
    asked = met.join(shipped(index.places, 50), "window")
    asked = asked.select("row", "window", "start", "size", "offset", "term", F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift"))
    asked = asked.withColumn("pos", F.col("start") + F.col("offset") + F.col("shift"))
    held = index.stored.select("row", "term", "pos").join(shipped(checkpoint(met.select("row").distinct()), 30), "row", "left_semi")
    found = asked.join(held, ["row", "term", "pos"]).groupBy("row", "window", "start", "size").agg(
        F.count_if(F.col("shift") == 0).alias("same"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, offset)"))).alias("near")
    )
    exact = F.col("same") == F.col("size")
    return found.where(exact | (5 * F.col("near") >= 4 * F.col("size"))).select("row", "window", "start", "size", exact.alias("exact"))


def phrase_matches(index: Index) -> DataFrame:
    """doc_id, item_id, start, size: every exact occurrence of a window of an item; start counts words from 1."""
    met = matches(index, 0).where("exact").join(index.rows(), "row").join(index.items, "window")
    return met.select("doc_id", "item_id", "start", "size")


def proximity_matches(index: Index, slop: int = SLOP) -> DataFrame:
    """doc_id, item_id, start: where four fifths of an item's window stand at most ``slop`` words from their places."""
    return matches(index, slop).join(index.rows(), "row").join(index.items, "window").select("doc_id", "item_id", "start").distinct()


def contaminated(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = SLOP) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an exact occurrence), item_ids and near_ids (with exact and with near windows, sorted as strings), contaminated."""
    index = Index(docs, items, width)
    found = checkpoint(matches(index, slop))
    hit = found.where("exact").select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    hit = hit.groupBy("row").agg(F.count("*").alias("n_hit"))
    of = found.groupBy("row", "window").agg(F.max("exact").alias("exact")).join(index.items, "window")
    of = of.groupBy("row", F.col("item_id").cast("string").alias("item")).agg(F.max("exact").alias("exact"))
    ids = lambda c: F.array_sort(F.collect_list(c))
    by = of.groupBy("row").agg(ids(F.when(F.col("exact"), F.col("item"))).alias("item_ids"), ids("item").alias("near_ids"))
    out = index.rows().join(hit, "row", "left").join(by, "row", "left")
    n, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("near_ids", none).alias("near_ids"), (n > 0).alias("contaminated"))
