"""Session helpers: defaults for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "saldo") -> SparkSession:
    """A session for tests and benches. On a cluster the caller passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SALDO_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the reliable folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting only a local master may use a folder of our own, as in tests; elsewhere each executor
    would write to its own disk, so the call fails. The table is Parquet: rows are worked out once and take a fraction of what
    Spark's own checkpoints take, which are kept for columns that Parquet does not hold.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    names = [c.lower() for c in df.columns]
    if not names or len(set(names)) < len(names) or any(k in df.schema.simpleString() for k in ("void", "interval", "variant")):
        return df.checkpoint(eager=True)
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="saldo-checkpoint-")
