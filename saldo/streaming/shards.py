"""Keyed upserts from a stream into a table cut into shards of keys; a batch rewrites only the shards it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.session import checkpoint
from saldo.sources.stores import upsert


def merge_shards(path: str, key: str, order: str, shards: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: the latest row of each key by ``order`` goes into ``path``, partitioned by a hash of the key.

    Of a batch and the table the later row stays, so batches may repeat and come late. The rows of the touched shards are written
    anew by dynamic partition overwrite; the others are neither read nor written.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        latest = checkpoint(latest.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")))
        touched = [r["shard"] for r in latest.select("shard").distinct().collect()]  # ``shards`` at most
        if not touched:
            return
        now = F.current_timestamp()
        try:
            old = spark.read.parquet(path).filter(F.col("shard").isin(touched))
        except Exception as e:  # the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = latest.limit(0).withColumns({"created_at": now, "updated_at": now})
        newer = latest.join(old.select(key, F.col(order).alias("_at")), key, "left").filter(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_at")
        merged = upsert(old.drop("shard"), newer.drop("shard"), key, now)
        # Written rows, so that no task reads what the job replaces.
        merged = checkpoint(merged.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")))
        merged.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)

    return write
