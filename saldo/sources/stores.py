"""Sinks and keyed stores: reports, packages, content-addressed records, versioned upserts, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.ids import content_hash
from saldo.operators import sequence


def write_reports(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report_text(df: DataFrame, path: str, columns: list[str]) -> None:
    """One line of text per row, cells joined as a table row."""
    df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)


def write_packages(df: DataFrame, path: str, key: str = "contract_id", only_touched: bool = False) -> None:
    """One folder per contract; rows are gathered per contract so that a contract is not scattered over every task's file.

    With ``only_touched`` the folders of contracts that ``df`` does not have stay as they are.
    """
    rows = df.repartition(key, F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite")
    rows.option("partitionOverwriteMode", "dynamic" if only_touched else "static").partitionBy(key).parquet(path)


def content_records(df: DataFrame, content: str) -> DataFrame:
    """Distinct contents under their hash, with the number of times they came."""
    rest = [c for c in df.columns if c != content]
    return df.withColumn("hash", content_hash(F.col(content))).groupBy("hash").agg(F.min(F.struct(*rest, content)).alias("r"), F.count(F.lit(1)).alias("copies")).select("hash", "r.*", "copies")


def add_content(df: DataFrame, content: str, path: str) -> DataFrame:
    """Append contents the store does not have yet; returns what was added."""
    spark = df.sparkSession
    new = content_records(df, content).withColumn("shard", F.substring("hash", 1, 2))
    try:
        new = new.join(spark.read.parquet(path).select("hash"), "hash", "left_anti")
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").partitionBy("shard").parquet(path)
    return new


def upsert(existing: DataFrame, incoming: DataFrame, key: str, now: Column) -> DataFrame:
    """Existing rows updated by incoming ones of the same key: new values win where given, created_at stays, updated_at moves.

    Both sides hold one row per key, with created_at and updated_at in the existing one.
    """
    names = [c for c in incoming.columns if c not in (key, "created_at", "updated_at")]
    e = existing.select(key, F.struct(*[c for c in existing.columns if c != key]).alias("_e"))
    i = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("_i"))
    given = F.col("_i.created_at") if "created_at" in incoming.columns else F.lit(None)
    return e.join(i, key, "full").select(
        key, *[F.coalesce(F.col(f"_i.{n}"), F.col(f"_e.{n}")).alias(n) for n in names], F.coalesce(F.col("_e.created_at"), given, now).alias("created_at"),
        F.when(F.col("_i").isNotNull(), now).otherwise(F.col("_e.updated_at")).alias("updated_at"))


def keep_examples(examples: DataFrame) -> DataFrame:
    """Latest version of each example, with its whole text."""
    last = examples.groupBy("example_id").agg(F.max_by(F.struct("tag", "text", "at"), "at").alias("r"))
    return last.select("example_id", "r.tag", "r.text", "r.at")


def latest_by_tag(examples: DataFrame, k: int = 2) -> DataFrame:
    return sequence.best(examples, ["tag"], [F.desc("at"), F.desc("example_id")], k)
