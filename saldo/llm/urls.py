"""URL filters: host and path rules, and for the rest the ratio of two character language models.

Rules allow or block a host with its subdomains from a path on; the longest rule that fits decides. Urls that rules decide are the accepted and rejected
examples of two smoothed variable-order Markov models: the probability of a character after up to ``ORDER`` others is interpolated
with that after one less, down to even odds of all characters; the longest context that was seen decides. A url's score is its log-likelihood
difference for each character, and a fifth of the examples, held out by a hash, calibrate the score above which urls are allowed.

Only DataFrame functions run. Equal hosts and paths are scored once. Models are joined, by broadcast only when their counted rows fit.
A null url or one without ``://`` has empty host and path and is scored as such. Without examples of both kinds every url gets score 0 and
is allowed. Rows that repeat a page_id are judged each for itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import shipped
from saldo.session import checkpoint

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Characters of context, weight of the shorter context, characters of the models' alphabet, bins of scores.
ORDER, WEIGHT, ALPHABET, BINS = 3, 4.0, 40, 1000


def parsed(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits)


def spelled(host: Column, path: Column) -> Column:
    """The text that models read: letters lower-cased, digits alike, other unusual characters alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.concat(host, path)), "[0-9]", "0"), r"[^a-z0./_~%\-]", "?")


def grams(texts: DataFrame, size: int) -> DataFrame:
    """A row for each character with up to ``size`` - 1 before it: column gram; and the columns of ``texts``."""
    padded = F.concat(F.lit("^" * (size - 1)), "text", F.lit("$"))
    at = texts.withColumn("_p", padded).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("text") + 1)))
    return at.withColumn("gram", F.substring(F.col("_p"), F.col("_i"), F.lit(size))).drop("_p", "_i")


def models(examples: DataFrame, order: int = ORDER, weight: float = WEIGHT) -> DataFrame:
    """size, gram, seen, ratio: log-likelihood differences for grams of up to ``order`` + 1 characters.

    Of a gram that was seen, the ratio is the last character's after the others; of its context (``seen`` false, one character less), what
    a character that was never seen there adds to its ratio after the shorter context.
    """
    longest = grams(examples, order + 1).groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    sizes = F.array(*[F.struct(F.lit(n).alias("size"), F.substring("gram", order + 2 - n, n).alias("gram")) for n in range(1, order + 2)])
    seen = longest.select(F.explode(sizes).alias("g"), "yes", "no").groupBy("g.size", "g.gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    seen = checkpoint(seen.withColumn("context", F.expr("left(gram, size - 1)")))
    contexts = checkpoint(seen.groupBy("size", "context").agg(F.sum("yes").alias("all_yes"), F.sum("no").alias("all_no")))
    mixed = lambda c, a, b: (F.col(c) + weight * F.col(b)) / (F.col(a) + weight)
    known = []
    for n in range(1, order + 2):
        now = seen.where(F.col("size") == n).drop("size").join(shipped(contexts.where(F.col("size") == n).drop("size"), 60), "context")
        if n == 1:
            now = now.withColumns({"p": F.lit(1.0 / ALPHABET), "q": F.lit(1.0 / ALPHABET)})
        else:
            less = known[-1].select(F.col("gram").alias("tail"), "p", "q")
            now = now.withColumn("tail", F.substring("gram", 2, n)).join(shipped(less, 60), "tail")
        known.append(checkpoint(now.select("gram", mixed("yes", "all_yes", "p").alias("p"), mixed("no", "all_no", "q").alias("q"))))
    out = contexts.select("size", F.col("context").alias("gram"), F.lit(False).alias("seen"), (F.log(F.col("all_no") + weight) - F.log(F.col("all_yes") + weight)).alias("ratio"))
    for n, k in enumerate(known, 1):
        out = out.unionByName(k.select(F.lit(n).alias("size"), "gram", F.lit(True).alias("seen"), (F.log("p") - F.log("q")).alias("ratio")))
    return out


def scored(texts: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """text, score: mean log-likelihood difference of a text's characters under the two interpolated models, whose rows are written."""
    at = grams(texts.select("text"), order + 1)
    each = at.select("gram").distinct()  # every different gram is looked up once
    best = F.lit(0.0)
    for n in range(1, order + 2):
        for seen, size in ((True, n), (False, n - 1)):
            name = f"{'r' if seen else 'b'}{n}"
            part = shipped(model.where((F.col("size") == n) & (F.col("seen") == F.lit(seen))).select(F.col("gram").alias("_g"), F.col("ratio").alias(name)), 40)
            each = each.join(part, F.substring("gram", order + 2 - n, size) == F.col("_g"), "left").drop("_g")
        # A character not seen in this context has the shorter context's ratio, times the context's weight for unseen ones.
        best = F.coalesce(F.col(f"r{n}"), F.coalesce(f"b{n}", F.lit(0.0)) + best)
    ratios = shipped(checkpoint(each.select(F.col("gram").alias("_g"), best.alias("ratio"))), 40)
    of = at.join(ratios, F.col("gram") == F.col("_g")).groupBy("text").agg(F.sum("ratio").alias("sum"), F.count("*").alias("n"))
    return of.select("text", (F.col("sum") / F.col("n")).alias("score"))


def border(scores: DataFrame) -> float:
    """The score that best parts held-out examples (columns yes, no): equal weight for both kinds. Ties go to the lower one.

    Scores are counted in bins between the least and the greatest of them.
    """
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    if low is None:
        return 0.0
    high = max(high, low + 1e-9)
    slot = F.greatest(F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
    bins = sorted(scores.groupBy(slot.alias("b")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect())  # at most BINS rows
    yes, no = sum(r["yes"] for r in bins), sum(r["no"] for r in bins)
    if not yes or not no:
        return 0.0
    best, at, lost, gone = 1.0, 0.0, 0, 0
    for r in bins:
        lost, gone = lost + r["yes"], gone + r["no"]
        if lost / yes + 1 - gone / no < best:
            best, at = lost / yes + 1 - gone / no, low + (r["b"] + 1) * (high - low) / BINS
    return at


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of urls without a rule) of every row."""
    host, path = parsed(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = p.withColumn("rule", ruled(F.col("host"), F.col("path"), rules)).withColumn("text", spelled(F.col("host"), F.col("path")))
    p = checkpoint(p)
    allow = [r for r, v in rules if v == "allow"]
    yes = F.col("rule").isin(*allow)
    examples = p.where("rule IS NOT NULL").groupBy("text").agg(F.sum(yes.cast("long")).alias("yes"), F.sum((~yes).cast("long")).alias("no"))
    held = F.pmod(F.xxhash64("text"), F.lit(5)) == 0
    examples = checkpoint(examples.withColumn("held", held))
    model = checkpoint(models(examples.where("NOT held").select("text", "yes", "no"), order))
    some = examples.agg(F.sum("yes"), F.sum("no")).first()
    if not some[0] or not some[1]:
        return p.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull() | yes, F.lit("allow")).otherwise("block").alias("verdict"), F.when(F.col("rule").isNull(), F.lit(0.0)).alias("score"))
    test = examples.where("held")
    least = border(checkpoint(scored(test, model, order).join(test.select("text", "yes", "no"), "text")))
    scores = shipped(checkpoint(scored(p.where("rule IS NULL").select("text").distinct(), model, order).withColumnRenamed("text", "_x")), 150)
    out = p.join(scores, (F.col("text") == F.col("_x")) & F.col("rule").isNull(), "left")
    good = F.when(F.col("rule").isNotNull(), yes).otherwise(F.coalesce(F.col("score"), F.lit(0.0)) >= least)
    return out.select("page_id", "host", "path", "rule", F.when(good, F.lit("allow")).otherwise("block").alias("verdict"), "score")
