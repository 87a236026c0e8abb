"""Keyed upserts from a stream into versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.sources.stores import upsert


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions under a path, read through the cluster's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    out = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Latest finished version, or the latest below ``before``."""
    v = [x for x in _versions(spark, path) if before is None or x < before]
    return spark.read.parquet(f"{path}/v={v[-1]}") if v else None


def merge_batches(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: batch n becomes version n. A repeated batch rewrites its own version from the one before it."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != key]
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
        now = F.current_timestamp()
        old = current(spark, path, before=n)
        new = latest.withColumns({"created_at": now, "updated_at": now}) if old is None else upsert(old, latest, key, now)
        new.write.mode("overwrite").parquet(f"{path}/v={n}")

    return write
