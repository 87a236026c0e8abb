"""Unexplained copago: lines that match exactly one item, and the rest, per account."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.operators import matching as M
from saldo.sources import star


def unexplained_copago(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, lines, matched, repeated, copago, unexplained."""
    m = M.amount_or_copago_match(star.settlement_lines(spark, sf_dir), star.charges(spark, sf_dir))
    lines = star.settlement_lines(spark, sf_dir).select("account", "line_id", "copago").join(m, ["account", "line_id"])
    return lines.groupBy("account").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("status") == "OK").alias("matched"), F.count_if(F.col("status") == "PARTIAL").alias("repeated"),
        F.sum("copago").alias("copago"), F.coalesce(F.sum(F.when(F.col("status") != "OK", F.col("copago"))), F.lit(0)).alias("unexplained"))
