"""Many contracts side by side: families, variance, metrics, golden comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import lexicon as lx
from saldo.functions.rules import first_match


def families(columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Family of each contract: its column ids and a size class. Column ids are those of one page, a handful."""
    c = columns.groupBy("contract_id").agg(F.array_join(F.array_sort(F.collect_set("column_id")), "|").alias("columns"))
    r = rows.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"))
    size = first_match([("LITE", F.col("n") < 5), ("STANDARD", F.col("n") < 15)], "COMPLEX")
    return c.join(r, "contract_id").select("contract_id", F.concat(F.lit("FAMILY["), "columns", F.lit("]["), size, F.lit("]")).alias("family"))


def family_sizes(fam: DataFrame) -> DataFrame:
    return fam.groupBy("family").agg(F.count(F.lit(1)).alias("contracts"))


def cell_variance(cells: DataFrame) -> DataFrame:
    """Contracts per value of each cell, and whether a cell varies across contracts."""
    v = cells.groupBy("row_id", "column_id", "value").agg(F.count_distinct("contract_id").alias("contracts"))
    k = v.groupBy("row_id", "column_id").agg(F.count(F.lit(1)).alias("values"))
    return v.join(k, ["row_id", "column_id"]).select("row_id", "column_id", "value", "contracts", (F.col("values") > 1).alias("varies"))


def batch_summary(status: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    ok = F.count_if(F.col("status").isin("PASS", "WARN"))
    return status.agg(n.alias("contracts"), ok.alias("passed"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("review"), (ok / n).alias("rate"))


def contract_metrics(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Critical rows, caps by unit, percents and modality columns of each contract."""
    num = F.col("value").try_cast("double")
    unit = F.col("unit")
    critical = {r: F.bool_or(F.col("row_id") == r).cast("int") for r in lx.CRITICAL_ROWS}
    found = F.lit(0)
    for c in critical.values():
        found = found + c
    uf = F.when(unit == "UF", num)
    g = cells.groupBy("contract_id").agg(
        F.count_distinct("row_id").alias("rows"), found.alias("critical_found"), F.count(uf).alias("uf_caps"), F.min(uf).alias("uf_min"), F.max(uf).alias("uf_max"),
        F.count(F.when(unit == "%", num)).alias("percents"), F.max(F.when(unit == "%", num)).alias("max_coverage"), F.count(F.when(unit.rlike("AC2|VAM|VA"), num)).alias("fee_multiples"),
        F.count_if(F.lower("value").rlike("sin tope|sin_tope")).alias("uncapped"))
    label = F.lower("column_id")
    m = columns.groupBy("contract_id").agg(F.count_if(label.rlike("pref|red")).alias("preferred_columns"), F.count_if(label.rlike("libre|le")).alias("free_columns"))
    missing = F.lit(len(lx.CRITICAL_ROWS)) - F.col("critical_found")
    return g.join(m, "contract_id", "left").select("*", missing.alias("critical_missing"), F.when(missing > 3, "WARN").otherwise("SUCCESS").alias("status"))


def cross_report(metrics: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return metrics.agg(n.alias("contracts"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), (F.count_if(F.col("status") == "SUCCESS") / n).alias("rate"), F.sum("uncapped").alias("uncapped"))


def extremes(simulated: DataFrame, k: int = 5) -> DataFrame:
    """The k contracts that cover most and the k that cover least."""
    best = simulated.orderBy(F.desc("covered"), "contract_id").limit(k).withColumn("side", F.lit("BEST"))
    worst = simulated.orderBy("covered", "contract_id").limit(k).withColumn("side", F.lit("WORST"))
    return best.unionByName(worst).select("side", "contract_id", "covered")


def golden_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids missing from or extra in the actual set."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = actual.select(key).distinct().withColumn("_a", F.lit(True))
    j = e.join(a, key, "full")
    return j.filter("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "MISSING").otherwise("EXTRA").alias("diff"))


def verdict(diffs: DataFrame) -> DataFrame:
    g = diffs.agg(F.count_if(F.col("diff") == "MISSING").alias("missing"), F.count_if(F.col("diff") == "EXTRA").alias("extra"))
    return g.select("missing", "extra", first_match([("REGRESSION", F.col("missing") > 0), ("FAIL", F.col("extra") > 0)], "PASS").alias("verdict"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one of two tables has; empty when they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("side", F.lit("RIGHT")))


def missing_items(expected: DataFrame, items: DataFrame) -> DataFrame:
    """Expected items the bill does not have, counted per group."""
    gone = expected.join(items.select("description", "total").distinct(), ["description", "total"], "left_anti")
    return gone.groupBy("grp").agg(F.count(F.lit(1)).alias("missing"), F.sum("total").alias("amount"))


def well_formed(cells: DataFrame) -> DataFrame:
    """Cells without a row, a column or an id are dropped."""
    return cells.filter("row_id is not null and row_id <> '' and column_id is not null and assignment_id is not null")
