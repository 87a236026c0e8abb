"""Substring dedup: remove words covered by a ``width``-word window that starts earlier somewhere.

Documents are dealt into blocks by a hash of their id, a few megabytes each. Three passes read the same dealt blocks:

1. Each block hashes its windows and gives its part of a count-min sketch: which cells of ``DEPTH`` hash rows it
   touches and how often. Cells are dealt by range into shards, where the blocks' parts are summed; each block gets back one bit a
   cell, whether the count is 2 or more. The sketch's width follows the input, and no task holds all of it.
2. Windows whose every cell is repeated (a superset of the repeated ones) go, once a block, to exact groups by 128 bits of hash.
   The group's smallest document stays first; each block gets back one bit a window, whether another block comes earlier.
3. Each block marks covered words and keeps the others.

A window that thousands of documents share costs one row part for each block, not for each copy.

Words are runs without ASCII white space, unchanged. Null and empty texts have no words. A row that repeats a doc_id comes after
the other by its text; an equal row is removed like any copy. A null doc_id comes last. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import buffers

#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Hash rows of the sketch, and its cells for each window of the input, about.
DEPTH, CELLS = 2, 4
#: Cells that a shard counts at once: 4 MB.
SHARD_BITS = 22
#: Bytes hashed at once.
PIECE = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and for each text the number of words before it."""
    solid = ~BLANK[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    starts[edge] |= solid[edge]
    starts = np.flatnonzero(starts)
    before = np.searchsorted(starts, offsets)
    out = [np.zeros(len(starts), np.uint64) for _ in ODD]
    lo = 0
    while lo < len(starts):  # a piece ends before a word, so words are hashed whole
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + PIECE)))
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(data)
        rel = starts[lo:hi] - a
        spans = np.diff(np.append(rel, b - a))
        inside = np.arange(b - a) - np.repeat(rel, spans)
        x = np.where(solid[a:b], data[a:b].astype(np.uint64) + np.uint64(1), np.uint64(0))
        # a text may end inside the blanks behind a word, never inside it
        for k, odd in enumerate(ODD):
            powers = np.multiply.accumulate(np.full(int(spans.max()), odd, np.uint64))
            out[k][lo:hi] = mixed(np.add.reduceat(x * powers[inside], rel) + np.uint64(k))
        lo = hi
    return out[0], out[1], before


def slid(h: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """Polynomial hash of each ``width`` consecutive values, by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, acc, have, base, size = np.array([odd], np.uint64), None, 0, h, 1  # an array: wraps without a warning
    left = width
    while left:
        if left & 1:
            part = base[have : have + n]
            acc = part if acc is None else acc * power + part
            have += size
        left >>= 1
        if left:
            base = base[:-size] * power + base[size:]
            size *= 2
            power = power * power
    return mixed(acc)


def windows(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, the text's number and the position of each window; the number of words before each text."""
    hs, gs, ds, ps, before = [], [], [], [], [0]
    lo, n = 0, len(texts)
    sizes = np.diff(buffers(texts)[1])
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), PIECE)) + lo)
        h, g, w = word_hashes(*buffers(texts.slice(lo, hi - lo)))
        count = np.maximum(0, np.diff(w) - width + 1)
        doc = np.repeat(np.arange(len(count)), count)
        pos = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = w[doc] + pos
        hs.append(slid(h, width, ODD[1])[at] if len(at) else h[:0])
        gs.append(slid(g, width, ODD[0])[at] if len(at) else g[:0])
        ds.append(doc + lo)
        ps.append(pos)
        before.extend((w[1:] + before[-1]).tolist())
        lo = hi
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(hs, np.uint64), join(gs, np.uint64), join(ds, np.int64), join(ps, np.int64), np.array(before)


def pack(x: np.ndarray) -> bytes:
    """Sorted or small integers in few bytes: byte planes, compressed."""
    return pa.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(b, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def ordered(t: pa.Table) -> pa.Table:
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # nulls come last


def cells(h: np.ndarray, g: np.ndarray, bits: int) -> list[np.ndarray]:
    """A cell for each hash row."""
    return [(x >> np.uint64(64 - bits)) + (np.uint64(k) << np.uint64(bits)) for k, x in enumerate((h, g))]


def parts(x: np.ndarray, bits: int):
    """(number, first, last) of runs of sorted x with the same x >> bits."""
    if not len(x):
        return
    s = x >> np.uint64(bits)
    cut = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(x))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(s[a]), a, b


MESSAGE = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
MESSAGE_DDL = "key long, block long, kind int, n long, a binary, b binary, c binary"


def messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MESSAGE)], schema=MESSAGE)


def sketch_part(t: pa.Table, width: int, bits: int) -> pa.Table:
    """Pass 1: the cells that a block touches, with 1 or 2 for once or more often."""
    t = ordered(t)
    block = t.column("block")[0].as_py()
    h, g, *_ = windows(t.column("text"), width)
    rows = []
    for x in cells(h, g, bits):
        cell, often = np.unique(x, return_counts=True)
        for shard, lo, hi in parts(cell, SHARD_BITS):
            low = (cell[lo:hi] & np.uint64((1 << SHARD_BITS) - 1)).astype(np.uint32)
            rows.append((shard, block, 0, hi - lo, pack(np.diff(low, prepend=np.uint32(0))), pack(np.minimum(often[lo:hi], 2).astype(np.uint8)), None))
    return messages(rows)


def merge_parts(t: pa.Table) -> pa.Table:
    """Sum the parts of one shard; tell each block which of its cells count 2 or more."""
    n, a, b = (t.column(k).to_pylist() for k in ("n", "a", "b"))
    count = np.zeros(1 << SHARD_BITS, np.uint8)
    for k in range(len(n)):
        at = np.cumsum(unpack(a[k], n[k], np.uint32), dtype=np.uint32)
        count[at] = np.minimum(count[at] + unpack(b[k], n[k], np.uint8), 2)
    rows = []
    for k, (block, shard) in enumerate(zip(t.column("block").to_pylist(), t.column("key").to_pylist())):
        at = np.cumsum(unpack(a[k], n[k], np.uint32), dtype=np.uint32)
        rows.append((shard, block, 0, n[k], np.packbits(count[at] >= 2).tobytes(), None, None))
    return messages(rows)


def candidates(t: pa.Table, told: pa.Table, width: int, bits: int, fan: int) -> pa.Table:
    """Pass 2: windows whose cells all count 2 or more, once a block, with their smallest document; and a memo of them for pass 3."""
    if not t.num_rows:
        return messages([])
    t = ordered(t)
    block = t.column("block")[0].as_py()
    h, g, d, _, _ = windows(t.column("text"), width)
    bit = dict(zip(told.column("key").to_pylist(), zip(told.column("n").to_pylist(), told.column("a").to_pylist())))
    often = np.ones(len(h), bool)
    for x in cells(h, g, bits):
        cell, back = np.unique(x, return_inverse=True)
        flag = np.zeros(len(cell), bool)
        for shard, lo, hi in parts(cell, SHARD_BITS):
            flag[lo:hi] = np.unpackbits(np.frombuffer(bit[shard][1], np.uint8), count=hi - lo)
        often &= flag[back]
    rows = [(-1 - block, block, 1, len(h), pa.compress(np.packbits(often).tobytes(), "zstd", asbytes=True), None, None)]
    pick = np.flatnonzero(often)
    first, _ = entries(h[pick], g[pick])
    ids = t.column("doc_id").to_numpy()[d[pick]][first] if t.column("doc_id").null_count == 0 else np.array([np.iinfo(np.int64).max if x is None else x for x in t.column("doc_id").to_pylist()], np.int64)[d[pick]][first]
    h, g = h[pick][first], g[pick][first]
    for shard, lo, hi in parts(h, 64 - fan):
        rows.append((shard, block, 2, hi - lo, pack(np.diff(h[lo:hi], prepend=np.uint64(0))), pack(g[lo:hi]), pack(ids[lo:hi].astype(np.int64))))
    return messages(rows)


def entries(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of different (h, g) in order: the place of the first, and for each window the number of its entry."""
    order = np.lexsort((g, h))  # stable: equal windows keep their order
    a, b = h[order], g[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.empty(len(a), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def resolve(t: pa.Table) -> pa.Table:
    """Exact groups of one shard: tell each block for which of its windows another block's document comes earlier. A memo passes."""
    if t.column("kind")[0].as_py() == 1:
        return t.select(MESSAGE.names).cast(MESSAGE)
    n, a, b, c = (t.column(k).to_pylist() for k in ("n", "a", "b", "c"))
    h = np.concatenate([np.cumsum(unpack(a[k], n[k], np.uint64), dtype=np.uint64) for k in range(len(n))])
    g = np.concatenate([unpack(b[k], n[k], np.uint64) for k in range(len(n))])
    d = np.concatenate([unpack(c[k], n[k], np.int64) for k in range(len(n))])
    order = np.lexsort((d, g, h))
    x, y = h[order], g[order]
    late = np.zeros(len(order), bool)
    late[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    rows, at = [], 0
    for k, (block, shard) in enumerate(zip(t.column("block").to_pylist(), t.column("key").to_pylist())):
        rows.append((shard, block, 2, n[k], np.packbits(late[at : at + n[k]]).tobytes(), None, None))
        at += n[k]
    return messages(rows)


def kept(t: pa.Table, told: pa.Table, width: int) -> pa.Table:
    """Pass 3: the words of each text that no later window covers."""
    names = ["doc_id", "n_words", "n_removed", "kept"]
    if not t.num_rows:
        return pa.Table.from_arrays([pa.array([], t.schema.field("doc_id").type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
    t = ordered(t)
    h, g, d, p, before = windows(t.column("text"), width)
    note = {k: (n, a) for k, kind, n, a in zip(*(told.column(c).to_pylist() for c in ("key", "kind", "n", "a"))) if kind == 2}
    memo = next(a for kind, a in zip(told.column("kind").to_pylist(), told.column("a").to_pylist()) if kind == 1)
    often = np.unpackbits(np.frombuffer(pa.decompress(memo, (len(h) + 7) // 8, "zstd", asbytes=True), np.uint8), count=len(h)).astype(bool)
    pick = np.flatnonzero(often)
    first, of = entries(h[pick], g[pick])
    flags = [np.unpackbits(np.frombuffer(note[k][1], np.uint8), count=note[k][0]) for k in sorted(note)]
    late = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    gone = late[of] | ~np.isin(np.arange(len(pick)), first) if len(pick) else np.zeros(0, bool)
    hit = before[d[pick]] + p[pick]
    edge = np.zeros(int(before[-1]) + 1, np.int32)
    np.add.at(edge, hit[gone], 1)
    np.add.at(edge, hit[gone] + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    texts, removed = [], []
    for k, x in enumerate(t.column("text").to_pylist()):
        mine = covered[before[k] : before[k + 1]]
        removed.append(int(mine.sum()))
        tokens = (x or "").encode().split()
        texts.append(b" ".join(w for w, z in zip(tokens, mine.tolist()) if not z) if removed[-1] else b" ".join(tokens))
    text = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.Table.from_arrays([t.column("doc_id").combine_chunks(), pa.array(np.diff(before)), pa.array(removed, pa.int64()), text], names=names)


def dedup(docs: DataFrame, width: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(deal, -(-size // block_bytes))
    bits = max(SHARD_BITS, int(size / 6 * CELLS).bit_length())
    fan = max(5, int(size / 6 / (1 << 18)).bit_length())
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition("block")
    part = dealt.groupBy("block").applyInArrow(lambda t: sketch_part(t, width, bits), MESSAGE_DDL)
    told = part.groupBy("key").applyInArrow(merge_parts, MESSAGE_DDL)
    found = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, m: candidates(t, m, width, bits, fan), MESSAGE_DDL)
    told = found.groupBy("key").applyInArrow(resolve, MESSAGE_DDL)
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, m: kept(t, m, width), "doc_id long, n_words long, n_removed long, kept string")
