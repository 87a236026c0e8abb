"""Columns that depend on texts, worked out once a text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.session import checkpoint

#: Different texts that are handed to every task.
FEW = 1 << 16


def by_text(df: DataFrame, keys: list[str], columns: dict[str, Column], few: int = FEW) -> DataFrame:
    """``df`` with columns that depend on ``keys`` alone, computed once for each different combination of the keys.

    Up to ``few`` combinations, counted first, meet the rows as a broadcast table; where there are more, every row computes its own.
    """
    texts = checkpoint(df.select(*keys).distinct().limit(few + 1))
    if texts.count() > few:
        return df.withColumns(columns)
    known = texts.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], *[c.alias(f"_v{i}") for i, c in enumerate(columns.values())])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(keys)])
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.join(F.broadcast(known), same, "left").select(*kept, *[F.col(f"_v{i}").alias(n) for i, n in enumerate(columns)])


def kinds(df: DataFrame, keys: list[str]) -> DataFrame:
    """Different combinations of the keys, worked out once, so that rules over them and the rows that look them up share one table."""
    return checkpoint(df.select(*keys).distinct())


def with_kinds(df: DataFrame, known: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """``df`` with the other columns of ``known``, which holds one row for each combination of the keys, nulls included.

    Up to ``few`` rows, counted first, are broadcast; otherwise Spark chooses the join.
    """
    k = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in known.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    k = F.broadcast(k) if known.limit(few + 1).count() <= few else k
    return df.join(k, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
