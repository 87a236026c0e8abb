"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is its number of leading ``>`` marks; consecutive lines of one level are a passage. Quoted passages and their
single lines are normalised (lower-cased, blanks as one), hashed with their conversation, and joined to the message that says the same in its own words
first. A message replies to the latest message that its outermost quotes come from. Threads are chains of replies; a message's order is
(thread, depth, turn), so that every reply follows what it answers.

Only DataFrame functions run. The own passages of all messages are reduced to the first message for each hash before they meet the quotes, so
that a common line costs one row. Null and empty texts say and quote nothing. A null conv_id or turn is kept, and links to nothing. Messages that
share conv_id and turn are one in links, and all get them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.session import checkpoint

MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: Stand before a passage and behind its level; in texts they count as blanks.
CUT, LEVEL = "\u0002", "\u0003"


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x02\x03\s ]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """row, conv_id, turn, level, said (normalised passage or line), whole (is it the whole passage)."""
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\r?\n")
    m = messages.select("row", "conv_id", "turn", F.transform(lines, lambda x: F.struct(level(x).alias("level"), normal(F.regexp_replace(x, MARKS, "")).alias("said"))).alias("l"))
    # Passages: a new one where the level changes or a line is blank. Marked in the lines, joined and split again, so the work follows the text's length.
    def marked(x, i):
        last = F.get(F.col("l"), i - 1)
        more = (i > 0) & (x["said"] != "") & (last["said"] != "") & (last["level"] == x["level"])
        return F.concat(F.when(more, F.lit(" ")).otherwise(F.concat(F.lit(CUT), x["level"].cast("string"), F.lit(LEVEL))), x["said"])

    m = m.withColumn("j", F.slice(F.split(F.array_join(F.transform("l", marked), ""), CUT), 2, 1 << 30))
    part = lambda x, k: F.get(F.split(x, LEVEL), F.lit(k))
    m = m.withColumn("p", F.transform("j", lambda x: F.struct(part(x, 0).cast("int").alias("level"), part(x, 1).alias("said"))))
    tagged = lambda c, whole: F.transform(c, lambda x: F.struct(x["level"].alias("level"), x["said"].alias("said"), F.lit(whole).alias("whole")))
    return m.select("row", "conv_id", "turn", F.explode(F.concat(tagged("p", True), tagged("l", False))).alias("x")).select("row", "conv_id", "turn", "x.level", "x.said", "x.whole").where("said <> ''")


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted (quoted passages), n_linked (those found), reply_to, thread, depth and place (their struct with turn, which orders a conversation) of every row."""
    m = messages.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text").cast("string").alias("text"))
    m = checkpoint(m.withColumn("row", F.monotonically_increasing_id()))
    key = F.sha2(F.concat_ws("\u0001", F.col("conv_id").cast("string"), "said"), 256)
    quoting = m.where(F.col("text").rlike(r"(?m)^[ \t]*>"))
    quotes = checkpoint(passages(quoting).where("level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("key", key))
    own = passages(m).where("level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("key", key)
    wanted = quotes.select("key").distinct()
    first = checkpoint(own.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("turn").alias("source")))
    met = quotes.join(first, "key", "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    outer = F.min("level").over(Window.partitionBy("row"))  # one message
    by = met.withColumn("outer", outer).groupBy("row").agg(
        F.sum(F.col("whole").cast("long")).alias("n_quoted"), F.sum((F.col("whole") & F.col("source").isNotNull()).cast("long")).alias("n_linked"),
        F.max(F.when(F.col("level") == F.col("outer"), F.col("source"))).alias("reply_to"),
    )
    m = checkpoint(m.join(by.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left").drop("_r"))

    # Threads: each round doubles the stretch of replies that a message looks back.
    up = m.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")).withColumn("depth", F.lit(1).cast("long"))
    up = checkpoint(up)
    while True:
        to = up.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_u"), F.col("depth").alias("_d"))
        longer = up.join(to, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        longer = checkpoint(longer.select("conv_id", "turn", F.coalesce("_u", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_t").isNotNull().alias("moved")))
        done = longer.where("moved").isEmpty()
        up = longer.drop("moved")
        if done:
            break
    m = m.join(up.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "up", "depth"), (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: level(x) == 0), "\n")
    thread, depth = F.coalesce("up", "turn"), F.coalesce("depth", F.lit(0))
    return m.select(
        "conv_id", "turn", "role", F.when(F.col("n_quoted") > 0, plain).otherwise(F.col("text")).alias("text"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to", thread.alias("thread"), depth.alias("depth"), F.struct(thread.alias("thread"), depth.alias("depth"), "turn").alias("place"),
    )
