"""Range joins as equi-joins on buckets with an exact residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("long")


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], x: str, lo: str, hi: str, width: float, eps: float = 0.0) -> DataFrame:
    """Points with every interval of the same keys that holds them, ends included, with tolerance ``eps``."""
    span = F.sequence(_bucket(F.col(lo) - eps, width), _bucket(F.col(hi) + eps, width))
    i = intervals.withColumn("_b", F.explode(span))
    p = points.withColumn("_b", _bucket(F.col(x), width))
    return p.join(i, [*keys, "_b"]).filter((F.col(x) >= F.col(lo) - eps) & (F.col(x) <= F.col(hi) + eps)).drop("_b")


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], l: tuple[str, str], r: tuple[str, str], width: float) -> DataFrame:
    """Pairs whose open intervals overlap. Both sides go to the buckets they touch; a pair counts in the first shared one."""
    a = left.withColumn("_b", F.explode(F.sequence(_bucket(F.col(l[0]), width), _bucket(F.col(l[1]), width))))
    b = right.withColumn("_b", F.explode(F.sequence(_bucket(F.col(r[0]), width), _bucket(F.col(r[1]), width))))
    first = F.greatest(_bucket(F.col(l[0]), width), _bucket(F.col(r[0]), width))
    return a.join(b, [*keys, "_b"]).filter((F.col("_b") == first) & (F.col(l[0]) < F.col(r[1])) & (F.col(l[1]) > F.col(r[0]))).drop("_b")
