"""Care episodes: sessionization, fee consolidation, classes and links between stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.rules import first_match, search
from saldo.operators import sequence

GAP_HOURS = 48


def episode_numbers(lines: DataFrame, keys: list[str], ts: str = "ts", gap_hours: int = GAP_HOURS) -> DataFrame:
    """Number the episodes of each key: a new one starts more than ``gap_hours`` after the previous date.

    Works on the distinct dates of a key, cut by month. Undated lines form episode 0.
    """
    stamp = F.col(ts).cast("timestamp")
    dates = lines.select(*keys, F.unix_micros(stamp).alias("_t")).filter("_t is not null").distinct()
    month = F.floor(F.col("_t") / (30 * 86_400_000_000))
    n = sequence.islands(dates, keys, "_t", F.lit(gap_hours * 3_600_000_000), name="episode", chunk=month)
    j = lines.withColumn("_t", F.unix_micros(stamp)).join(n, [*keys, "_t"], "left")
    return j.withColumn("episode", F.coalesce("episode", F.lit(0))).drop("_t")


def episodes(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode: dates, class, totals and whether the surgical team is complete."""
    code, d = F.col("code"), F.upper("description")
    surgical = code.rlike("^(1[1-9]|20|21)") | d.rlike("PABELLON|ANESTESISTA|QUIRURGICO|CIRUJANO|ARSENALERA")
    g = numbered.groupBy(*keys, "episode").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("lines"), F.sum("copago").alias("copago"), F.sum("bonif").alias("bonif"),
        F.bool_or(surgical).alias("_s"), F.bool_or(d.rlike(r"CIRUJANO|\(91\)")).alias("_a"), F.bool_or(d.rlike(r"ANESTESISTA|\(90\)")).alias("_b"),
        F.bool_or(d.rlike("ARSENALERA|AYUDANTE|PABELLONERA|8001001")).alias("_c"))
    return g.select(*keys, "episode", "start", "end", "lines", "copago", "bonif", F.when(F.col("_s"), "QUIRURGICO").otherwise("MEDICO").alias("kind"),
                    (F.col("_a") & F.col("_b") & F.col("_c")).alias("team_complete"))


def consolidated_fees(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """Fees by code and date inside an episode: the fractions of one act add up to one, within 0.15."""
    d = F.upper("description")
    fee = F.col("code").rlike("^(1[1-8]|22)") | d.rlike(r"CIRUJANO|ANESTESISTA|ARSENALERA|AYUDANTE|\(9[012]\)")
    g = numbered.filter(fee).groupBy(*keys, "episode", "code", "ts").agg(
        F.sum(F.col("qty").cast("decimal(18,4)")).alias("_q"), F.count(F.lit(1)).alias("parts"), F.sum("copago").alias("copago"))
    return g.select(*keys, "episode", "code", "ts", F.col("_q").cast("double").alias("qty"), "parts", "copago", (F.abs(F.col("_q") - 1) <= 0.15).alias("valid_split"))


def next_admission(stays: DataFrame, keys: list[str], hours: int = 24) -> DataFrame:
    """Urgent stays with the next admission of the key that starts within ``hours`` of their end.

    stays: keys, stay_id, start, end, urgent. Ends of urgent stays and starts of admissions share one time
    line; each end looks up the next start on it.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    starts = stays.filter(~F.col("urgent")).select(*keys, micros("start").alias("t"), F.lit(1).alias("k")).distinct()
    ends = stays.filter("urgent").select(*keys, micros("end").alias("t"), F.lit(0).alias("k")).distinct()
    day = F.floor(F.col("t") / (30 * 86_400_000_000))
    line = sequence.carry(ends.unionByName(starts), keys, ["t", "k"], day, nexts={"_next": F.when(F.col("k") == 1, F.col("t"))})
    near = line.filter("k = 0").select(*keys, "t", F.when(F.col("_next") - F.col("t") <= hours * 3_600_000_000, F.col("_next")).alias("_next"))
    first = stays.filter(~F.col("urgent")).groupBy(*keys, micros("start").alias("_next")).agg(F.min("stay_id").alias("admission"))
    u = stays.filter("urgent").withColumn("t", micros("end")).join(near, [*keys, "t"], "left").join(first, [*keys, "_next"], "left")
    return u.select(*keys, "stay_id", "admission")


def duplicated_rights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Urgent episodes that charge more than one base right."""
    d = F.upper("description")
    right = F.col("code").rlike("2001|2002|3101|3301") | d.rlike("DERECHO.*URGENCIA|DERECHO.*SALA")
    g = lines.groupBy(*keys).agg(F.bool_or(d.rlike("URGENCIA|EMERGENCIA")).alias("urgent"), F.count_if(right).alias("rights"))
    return g.select(*keys, "rights", (F.col("urgent") & (F.col("rights") > 1)).alias("alert"))


def unit_value_by_day(lines: DataFrame, values: DataFrame, fallback: float = 39750.0) -> DataFrame:
    """Indexed unit value on the day of each line, the constant where the day has none."""
    from saldo.functions.money import unit_value_on

    return lines.withColumn("day", F.to_date("ts")).join(values, "day", "left").withColumn("unit_value", unit_value_on(F.col("value"), fallback)).drop("value")
