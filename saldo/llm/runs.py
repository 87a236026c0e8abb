"""Periodic runs of words, by the grouping phase of Baier's suffix sorter.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that no word
beside it continues. Phase one of the sorter refines groups of positions by their longest Lyndon prefix, from the highest
group down, and so yields the Lyndon array with no suffix array; it is taken under the order of words and under its
reverse. A run's Lyndon roots are longest Lyndon prefixes under one of both orders, so neighbours of one group, one
width apart, mark it; comparing words on both sides (LCE) stretches the root to the run.

Only stretches whose words all lie in repeated word sequences of a text go in: every sequence of (least + 5) / 3 words of a
run stands once more in it, one period away. Each text is one unit of work, linear in its words but for the sorting of
their sequences.

Words are what stands between ASCII white space. Null, empty and blank texts have no words and no runs. Rows that repeat a
doc_id are read apart; the other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import bounded

LEAST, TIMES = 24, 3


def lyndon(ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(width, group) of every position: its longest Lyndon prefix's length, and a number that equal prefixes share.

    ``ranks`` are dense, from 0. A position's group is final once no higher group is left; it then leaves the chain of open
    positions, and the open position before it takes its prefix in: it rises to a new group above its own.
    """
    n, top = len(ranks), max(ranks, default=-1) + 1
    group, width = list(ranks), [1] * top
    members: list[list[int]] = [[] for _ in range(top)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    below, above = list(range(-1, top - 1)), list(range(1, top + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    g = top - 1
    while g >= 0:
        rising: dict[tuple[int, int], list[int]] = {}
        taker, times = -1, 0
        for s in members[g]:
            if group[s] != g:
                continue
            p, r = left[s], right[s]
            if r < n:
                left[r] = p
            if p < 0:
                continue
            right[p] = r
            if p == taker:
                times += 1
                continue
            if taker >= 0:
                rising.setdefault((times, group[taker]), []).append(taker)
            taker, times = p, 1
        if taker >= 0:
            rising.setdefault((times, group[taker]), []).append(taker)
        members[g] = []
        # Of one group, those that take more of this prefix are higher: they are put above it first.
        for (k, h), rows in sorted(rising.items(), key=lambda x: -x[0][0]):
            new, over = len(width), above[h]
            width.append(width[h] + k * width[g])
            members.append(rows)
            below.append(h)
            above.append(over)
            above[h] = below[over] = new
            for p in rows:
                group[p] = new
        g = below[g]
    of = np.array(group, np.int64)
    return np.array(width, np.int64)[of], of


def agreeing(x: np.ndarray, a: int, period: int, step: int) -> int:
    """How many words from ``a`` on (step 1) or back from ``a`` (step -1) equal those one period further right."""
    limit = len(x) - period - a if step > 0 else a + 1
    done, size = 0, 64
    while done < limit:
        m = min(size, limit - done)
        lo = a + done if step > 0 else a - done - m + 1
        differs = x[lo : lo + m] != x[lo + period : lo + period + m]
        if differs.any():
            return done + int(np.argmax(differs if step > 0 else differs[::-1]))
        done, size = done + m, size * 2
    return done


def runs_of(x: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers."""
    found = set()
    ranks = np.unique(x, return_inverse=True)[1]
    for order in (ranks, ranks.max(initial=0) - ranks):
        width, group = lyndon(order.tolist())
        at = np.arange(len(x))
        at = at[at + width < len(x)]
        roots = at[group[at] == group[at + width[at]]]
        roots = roots[np.lexsort((roots, width[roots]))]
        before, stop = 0, 0
        for i, q in zip(roots.tolist(), width[roots].tolist()):
            # Two stretches of one period share less than a period: a root inside the last one has the same run.
            if q == before and i + q <= stop:
                continue
            stop = i + q + agreeing(x, i, q, 1)
            start = i - agreeing(x, i - 1, q, -1)
            before = q
            if stop - start >= max(least, times * q):
                found.add((start, stop - start, q))
    return found


def repeated_parts(x: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least ``least`` words that are covered by repeated sequences of (least + 5) / 3 words."""
    k = (least + 5) // 3
    if len(x) < least:
        return []
    h, m = np.zeros(len(x) - k + 1, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for j in range(k):  # equal sequences have equal sums; others that share one only let a stretch pass
        h = h * m + x[j : j + len(h)].astype(np.uint64)
    line = np.sort(h)
    twice = line[1:][line[1:] == line[:-1]]
    if not len(twice):
        return []
    seen = np.isin(h, twice).astype(np.int64)
    cover = np.zeros(len(x) + 1, np.int64)
    cover[: len(h)] += seen
    cover[k:] -= seen
    inside = np.concatenate([[0], np.cumsum(cover)[: len(x)] > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)
    return [(a, b) for a, b in edges.tolist() if b - a >= least]


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    found = ((a + s, n, q) for a, b in repeated_parts(x, least) for s, n, q in runs_of(x[a:b], least, times))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, of each run only its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(w for w, g in zip(words, np.cumsum(gone).tolist()) if not g)


def split(doc_id, text: str | None) -> list[bytes]:
    """Words of a text, between ASCII white space."""
    return (text or "").encode().split()


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES, read: Callable[[object, str | None], list[bytes]] = split) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period), top (the run of most periods, the first of equals) and collapsed of every row.

    ``read`` gives the words of (doc_id, text); ``times`` is at least 3.
    """
    if times < 3 or least < 1:
        raise ValueError("runs hold at least three periods and one word")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            all_runs, tops, texts = [], [], []
            for d, t in zip(b.column(0), b.column(1)):
                words = read(d.as_py(), t.as_py())
                runs = word_runs(words, least, times)
                dicts = [dict(zip(("start", "length", "period"), r)) for r in runs]
                all_runs.append(dicts)
                tops.append(max(dicts, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None))
                texts.append(collapsed(words, runs).decode())
            cols = [b.column(0), pa.array(all_runs, pa.list_(item)), pa.array(tops, item), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "runs", "top", "collapsed"])

    kind, struct = docs.schema["doc_id"].dataType.simpleString(), "struct<start:long,length:long,period:long>"
    return bounded(docs.select("doc_id", F.col("text").cast("string"))).mapInArrow(run, f"doc_id {kind}, runs array<{struct}>, top {struct}, collapsed string")
