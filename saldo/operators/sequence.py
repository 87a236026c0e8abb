"""Order-dependent state over groups of any size.

A window partitioned by the group key puts a whole group into one task. The functions here cut a
group into chunks along its order, work inside the chunks, and carry the state of the chunks before
(a few values per chunk) into each row. Groups of no more rows than a chunk may have are one window each,
so that they need no state and no join. The largest unit one task holds is a chunk.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.session import checkpoint

CHUNK = 8192
_C = "_chunk"


def by_pos(pos: str = "pos", rows: int = CHUNK) -> Column:
    """Chunk number of an integer position."""
    if rows & (rows - 1):
        return F.floor(F.col(pos) / rows).cast("long")
    # A shift is null for a null position only, which a division does not tell: so rows are counted without their position.
    return F.shiftright(F.col(pos).cast("long"), rows.bit_length() - 1)


def carry(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    priors: dict[str, Column] | None = None,
    follows: dict[str, Column] | None = None,
    whole: int = CHUNK,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ordered state columns; ``chunk`` must not decrease along ``order``.

    sums:   running sum including the row
    lasts:  last non-null value up to and including the row
    nexts:  first non-null value from the row on
    before: value of the previous row
    after:  value of the next row
    priors: last non-null value before the row
    follows: first non-null value after the row

    Groups of up to ``whole`` rows are taken whole. ``counted`` holds at least the rows of ``df`` by their keys, where those are cheaper to count.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    before, after, priors, follows = before or {}, after or {}, priors or {}, follows or {}
    d = df.withColumn(_C, chunk)
    n = d.withColumn("_o", F.col(_C).isNull()) if counted is None else counted.withColumn("_o", F.lit(False))
    large = checkpoint(n.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_o").alias("_open")).filter(
        (F.col("_n") > whole) | F.col("_open") | reduce(or_, [F.col(k).isNull() for k in keys])).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    states = (sums, lasts, nexts, before, after, priors, follows)
    if large.isEmpty():
        return _whole(df, keys, order, *states)
    # At most one group for ``whole`` rows, but for those without a key or chunk.
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return _whole(df.join(large, same, "left_anti"), keys, order, *states).unionByName(_chunked(d.join(large, same, "left_semi"), keys, order, *states))


def _whole(df: DataFrame, keys: list[str], order: list[str], sums: dict, lasts: dict, nexts: dict, before: dict, after: dict, priors: dict, follows: dict) -> DataFrame:
    """``carry`` for groups that one task may hold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, onward = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = {n: F.coalesce(F.sum(v).over(upto), F.lit(0)) for n, v in sums.items()}
    out |= {n: F.last(v, ignorenulls=True).over(upto) for n, v in lasts.items()}
    out |= {n: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for n, v in priors.items()}
    out |= {n: F.first(v, ignorenulls=True).over(onward) for n, v in nexts.items()}
    out |= {n: F.first(v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)) for n, v in follows.items()}
    out |= {n: F.lag(v).over(w) for n, v in before.items()}
    out |= {n: F.lead(v).over(w) for n, v in after.items()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()])


def _chunked(d: DataFrame, keys: list[str], order: list[str], sums: dict, lasts: dict, nexts: dict, before: dict, after: dict, priors: dict, follows: dict) -> DataFrame:
    """``carry`` for groups of any size, in chunks."""
    rank = F.struct(*order)
    inner = Window.partitionBy(*keys, _C).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = inner.rowsBetween(Window.currentRow, Window.unboundedFollowing)

    aggs = [F.lit(1).alias("_n")]
    aggs += [F.sum(v).alias(f"_s_{n}") for n, v in sums.items()]
    aggs += [F.max_by(v, F.when(v.isNotNull(), rank)).alias(f"_l_{n}") for n, v in (lasts | priors).items()]
    aggs += [F.min_by(v, F.when(v.isNotNull(), rank)).alias(f"_f_{n}") for n, v in (nexts | follows).items()]
    aggs += [F.max_by(F.struct(v.alias("v")), rank).alias(f"_b_{n}") for n, v in before.items()]
    aggs += [F.min_by(F.struct(v.alias("v")), rank).alias(f"_a_{n}") for n, v in after.items()]
    chunks = d.groupBy(*keys, _C).agg(*aggs)

    outer = Window.partitionBy(*keys).orderBy(_C)
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    later = outer.rowsBetween(1, Window.unboundedFollowing)
    carried = [F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in sums]
    carried += [F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_l_{n}") for n in [*lasts, *priors]]
    carried += [F.first(f"_f_{n}", ignorenulls=True).over(later).alias(f"_f_{n}") for n in [*nexts, *follows]]
    carried += [F.lag(f"_b_{n}").over(outer).alias(f"_b_{n}") for n in before]
    carried += [F.lead(f"_a_{n}").over(outer).alias(f"_a_{n}") for n in after]
    state = chunks.select(*keys, _C, *carried)

    local = {f"_r_{n}": F.sum(v).over(upto) for n, v in sums.items()}
    local |= {f"_p_{n}": F.last(v, ignorenulls=True).over(upto) for n, v in lasts.items()}
    local |= {f"_q_{n}": F.first(v, ignorenulls=True).over(onward) for n, v in nexts.items()}
    local |= {f"_p_{n}": F.last(v, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)) for n, v in priors.items()}
    local |= {f"_q_{n}": F.first(v, ignorenulls=True).over(inner.rowsBetween(1, Window.unboundedFollowing)) for n, v in follows.items()}
    local |= {f"_x_{n}": F.lag(F.struct(v.alias("v"))).over(inner) for n, v in before.items()}
    local |= {f"_y_{n}": F.lead(F.struct(v.alias("v"))).over(inner) for n, v in after.items()}
    j = d.withColumns(local).join(state, [*keys, _C], "left")
    out = {n: F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.coalesce(F.col(f"_s_{n}"), F.lit(0)) for n in sums}
    out |= {n: F.coalesce(f"_p_{n}", f"_l_{n}") for n in [*lasts, *priors]}
    out |= {n: F.coalesce(f"_q_{n}", f"_f_{n}") for n in [*nexts, *follows]}
    out |= {n: F.coalesce(f"_x_{n}", f"_b_{n}").getField("v") for n in before}
    out |= {n: F.coalesce(f"_y_{n}", f"_a_{n}").getField("v") for n in after}
    return j.select(*[F.col(f"`{c}`") for c in d.columns if c not in out and c != _C], *[v.alias(n) for n, v in out.items()])


def spread(df: DataFrame, keys: list[str], order: list[str], name: str = "_n") -> DataFrame:
    """Written rows with a number that grows along ``order`` inside a group and is cut by ranges of it: its ``reach`` is a chunk for ``carry``.

    Spark samples the ranges, so a group of any size is dealt evenly, whatever its values are.
    """
    cut = [*keys, *order]
    return checkpoint(df.repartitionByRange(*cut).sortWithinPartitions(*cut).withColumn(name, F.monotonically_increasing_id()))


def reach(name: str = "_n") -> Column:
    """Chunk of a row that ``spread`` has numbered."""
    return F.shiftright(name, 33)


def number(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "pos", counted: DataFrame | None = None) -> DataFrame:
    """1-based position inside the group. ``order`` must be unique inside a group; ``counted`` as in ``carry``."""
    return carry(df, keys, order, chunk, sums={name: F.lit(1).cast("long")}, counted=counted)


def ranked(df: DataFrame, keys: list[str], order: list[str], chunk: Column, limit: int | None = None, name: str = "n") -> DataFrame:
    """Rows numbered from 1 inside the group: all of them, or the first ``limit``."""
    if limit is None:
        return number(df, keys, order, chunk, name).withColumn(name, F.col(name).cast("int"))
    return best(df, keys, [F.col(c) for c in order], limit, rank=name)


def islands(df: DataFrame, keys: list[str], pos: str, gap: Column | int, name: str = "segment", chunk: Column | None = None) -> DataFrame:
    """Segment number: a new segment starts where the step from the previous row exceeds ``gap``."""
    c = by_pos(pos) if chunk is None else chunk
    stepped = carry(df, keys, [pos], c, before={"_prev": F.col(pos)})
    starts = F.when(F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > gap), 1).otherwise(0).cast("long")
    return carry(stepped, keys, [pos], c, sums={name: starts}).drop("_prev")


def attach_total(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group aggregates beside every row: pre-aggregated and joined back, so a hot group is never in one task."""
    totals = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(totals, keys, "left")


def best(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group by ``order``. Spark keeps only k rows per group before the shuffle."""
    n = rank or "_rank"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(n) <= k)
    return out if rank else out.drop(n)
