"""Quality rules with risk-controlled thresholds.

Base statistics of a text are array expressions over its own words: nothing is exploded or shuffled. Rules reject a text when a ratio exceeds a
cutoff. Cutoffs are learned for each stratum (language) from labelled good texts, by fixed-sequence tests: all rules start at their loosest cutoff and
are tightened in turn, one notch a step (``PATH``). A step is tested by the false rejections of all rules together: it passes if, were the true rate
above ``ALPHA``, as few would be seen with probability at most ``DELTA`` / (number of strata) by the exact binomial tail. The stratum takes the last
step before the first that fails. Tests in an order fixed beforehand need no further division over steps and rules; the division over strata is the
correction for the rest. So with confidence 1 - ``DELTA`` no stratum loses more than ``ALPHA`` of its good texts.

Strata with too few good labels for any step to pass (``least``) are pooled into one, whose guarantee holds for the pool as a whole; a pool that is
still too small, and a language without good labels, get no cutoff and reject nothing.

Null and empty texts have no words and fail the base rule. A null language is a stratum of its own. Labels of a document that disagree or are null
are not used; repeated rows are judged each for itself. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.common import BLANKS, shipped, words
from saldo.session import checkpoint

ALPHA, DELTA = 0.02, 0.05
#: Grid of cutoffs by rule, loosest first: symbols for 100 word characters, repeated lines for 100 words, words in repeated windows for 100.
GRID = {"symbols": (20.0, 15.0, 10.0, 7.0, 5.0, 3.0, 2.0, 1.0, 0.5), "lines": (20.0, 15.0, 10.0, 7.0, 5.0, 3.0, 2.0, 1.0, 0.5), "repeats": (45.0, 40.0, 35.0, 30.0, 25.0, 20.0, 15.0, 10.0, 5.0)}
SYMBOLS = "#*$%&|<>"
#: Cutoffs of all rules at each step, in the order of the tests.
PATH = [{r: g[(k + len(GRID) - 1 - i) // len(GRID)] for i, (r, g) in enumerate(GRID.items())} for k in range(len(GRID) * (min(map(len, GRID.values())) - 1) + 1)]


def repeated(w: Column, width: int = 3) -> Column:
    """Positions (from 0) of windows that occur twice or more. ``w``: a column of word arrays."""
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - width + 1, F.lit(0))), lambda _, i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)]).alias("t"), i.alias("i")))
    return F.sort_array(grams)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the base statistics of every whole text. Arrays used by element stand in columns, so they are made once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.col("lang").cast("string"), text.alias("_t"), words(text).alias("_w"), F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_l"))
    d = d.select(
        "doc_id", "lang", F.size("_w").cast("long").alias("n_words"), F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), "_w", repeated(F.col("_w")).alias("_g"),
    )
    same = lambda x, i, step: F.coalesce(F.get(F.col("_g"), i + step)["t"] == x["t"], F.lit(False))
    d = d.withColumn("_r", F.filter("_g", lambda x, i: same(x, i, -1) | same(x, i, 1)))
    hit = F.flatten(F.transform("_r", lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return d.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(F.array_distinct(hit)).cast("long").alias("n_repeat_words"))


def with_rules(stats: DataFrame) -> DataFrame:
    bad = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = lambda a, b: F.col(a) * 100.0 / F.greatest(F.col(b), F.lit(1))
    return stats.withColumns({"base_failed": bad, "symbols": ratio("n_symbols", "word_chars"), "lines": ratio("n_dup_lines", "n_words"), "repeats": ratio("n_repeat_words", "n_words")})


def allowed(n: Column, rate: float, level: Column) -> Column:
    """Most false rejections of n that show a rate below ``rate``: the largest k with P(Binomial(n, rate) <= k) <= level, or -1.

    The tail is summed term by term from its logarithm, up to the mean; a larger k never passes.
    """
    start = F.struct((n * F.log1p(F.lit(-rate))).alias("p"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("k"))

    def step(acc, i):
        tail = acc["tail"] + F.exp(acc["p"])
        more = acc["p"] + F.log((n - i) / (i + 1)) + F.log(F.lit(rate / (1 - rate)))
        return F.struct(F.when(n > i, more).otherwise(F.lit(float("-inf"))).alias("p"), tail.alias("tail"), F.when(tail <= level, i).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * rate)), start, step, lambda acc: acc["k"])


def least(strata: Column, alpha: float, delta: float) -> Column:
    """Good texts a stratum needs before a step without false rejections can pass."""
    return F.log(delta / strata) / F.lit(math.log1p(-alpha))


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """lang, stratum (the language, or pooled), n (its good texts), and a cutoff for each rule (null: none); one row a language."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"), F.sum(F.col("quality").isNull().cast("int")).alias("no"))
    good = good.where("lo = 1 AND hi = 1 AND no = 0").select(F.col("doc_id").alias("_d"))
    held = stats.where("NOT base_failed").join(good, F.col("doc_id") == F.col("_d"))
    # Steps reject more and more, so a text is described by the first step that rejects it.
    over = [F.when(functools.reduce(lambda a, b: a | b, [F.col(r) > c for r, c in step.items()]), F.lit(k)) for k, step in enumerate(PATH)]
    by = held.select("lang", F.coalesce(*over, F.lit(len(PATH))).alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    by = by.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("step") <= k, F.col("n")).otherwise(0)).alias(f"lost_{k}") for k in range(len(PATH))])
    # One row a language from here on.
    by = checkpoint(by.withColumn("strata", F.count("*").over(Window.partitionBy(F.lit(0)))))
    by = by.withColumn("pooled", F.col("n") < least(F.col("strata"), alpha, delta))
    w = Window.partitionBy("pooled", F.when(~F.col("pooled"), F.col("lang")))
    by = by.select("lang", "strata", "pooled", *[F.sum(c).over(w).alias(c) for c in ["n", *[f"lost_{k}" for k in range(len(PATH))]]])
    by = by.withColumn("most", allowed(F.col("n"), alpha, delta / F.col("strata")))
    failed = F.coalesce(*[F.when(F.col(f"lost_{k}") > F.col("most"), F.lit(k)) for k in range(len(PATH))], F.lit(len(PATH)))
    by = by.withColumn("passed", failed - 1)
    cut = lambda r: F.element_at(F.array(*[F.lit(step[r]) for step in PATH]), F.nullif(F.col("passed") + 1, F.lit(0)))
    return by.select("lang", F.when(F.col("pooled"), F.lit("pooled")).otherwise(F.coalesce("lang", F.lit("none"))).alias("stratum"), "n", *[cut(r).alias(f"{r}_cut") for r in GRID])


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and has_cutoffs (of its language's stratum) of every row."""
    stats = checkpoint(with_rules(statistics(docs)))
    cuts = checkpoint(cutoffs(stats, labels, alpha, delta)).withColumnRenamed("lang", "_s").drop("n")
    out = stats.join(shipped(cuts, 200), F.col("lang").eqNullSafe(F.col("_s")), "left")
    bad = F.lit(False)
    for r in GRID:
        bad = bad | F.coalesce(F.col(r) > F.col(f"{r}_cut"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), F.col("symbols_cut").isNotNull().alias("has_cutoffs"))
