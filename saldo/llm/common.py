"""What the operators share: reading tables, bounded Arrow batches, words of texts, connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.session import checkpoint, shared_folder

#: ASCII white space: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"
#: Words between white space, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that may be shipped to every executor at once.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded(df: DataFrame, records: int = 2000, size: str = "8m") -> DataFrame:
    """Keep Arrow batches small, so that a Python worker holds a few megabytes of text at a time."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def place(docs: DataFrame, name: str) -> int:
    """Number of a column, whatever the case of its letters."""
    return next(k for k, c in enumerate(docs.columns) if c.lower() == name)


def hidden(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: names of the columns that an operator adds cannot clash with those."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in rows of ``hidden``, under their own names."""
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fold(word: Column) -> Column:
    """Lower-case A-Z and nothing else. ASCII words take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, upper, upper.lower()))


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a pyarrow string array; null texts are empty."""
    import pyarrow as pa

    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds over all edges; their number is logarithmic in the size of a
    component. Only minima per node and edges move, so a hub is pre-aggregated before its shuffle and its join
    can be split. Each round is cut with a reliable checkpoint.
    """
    now = checkpoint(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        moved = large.join(low, F.col("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(moved.unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def shipped(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked for broadcast if its rows are counted to fit ``BROADCAST_BYTES``; else Spark shuffles it. Pass written rows."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: for rows too many to checkpoint."""
    folder = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
