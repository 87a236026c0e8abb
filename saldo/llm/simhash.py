"""SimHash near-duplicates by an exact, tiled comparison of fingerprints.

A text's words (A-Z lower-cased, split at ASCII white space) give shingles of ``width`` words; a fingerprint bit is 1
where it is set in over half of the shingles' XXH64 values. Different fingerprints are dealt into tiles by the bit
counts of their two halves. |popcount(a) - popcount(b)| never exceeds the distance of a and b, for whole words and summed
over halves, so only tiles whose counts differ by at most ``radius`` meet; there numpy xors everything with everything.
A pair of tiles reports links that span its groups, not all pairs, so that thousands of near copies stay linear.

Null and empty texts have fingerprint zero. Texts shorter than a shingle hash their whole word sequence. Equal texts,
repeated rows and rows that share a doc_id have equal components. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import bounded, components
from saldo.session import checkpoint

#: Fingerprints in a tile, about: 32 KB.
TILE = 4096


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return 0
    line = memoryview(b" ".join(tokens))
    n = max(1, len(tokens) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1)[:n]
    stops = ends[min(width, len(tokens)) - 1 :][:n] - 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        at = zip(starts[lo : lo + (1 << 15)].tolist(), stops[lo : lo + (1 << 15)].tolist())
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in at], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py().encode() if t.is_valid else b"", width, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", F.col("text").cast("string"))).mapInArrow(run, f"doc_id {kind}, fp long")


def spanning(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what lies within ``radius`` across (or inside) two tiles: one a node at most."""
    both = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    lab = np.arange(len(both))
    step = max(1, (1 << 19) // max(1, len(b)))
    for lo in range(0, len(a), step):
        near = np.bitwise_count(a[lo : lo + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + lo, j + shift
        while True:
            p, q = lab[i], lab[j]
            open_ = p != q
            if not open_.any():
                break
            i, j, p, q = i[open_], j[open_], p[open_], q[open_]
            np.minimum.at(lab, np.maximum(p, q), np.minimum(p, q))
            while (lab[lab] != lab).any():
                lab = lab[lab]
    moved = np.flatnonzero(lab != np.arange(len(both)))
    return both[moved], both[lab[moved]]


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v): links between different fingerprints (column fp) that connect all that differ in at most ``radius`` bits."""
    low, high = F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = checkpoint(fps.select("fp").distinct().select("fp", low.alias("p"), high.alias("q")))
    # At most 33 x 33 cells exist, so their counts may go to every task.
    parts = cells.groupBy("p", "q").agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = checkpoint(
        cells.join(F.broadcast(parts), ["p", "q"])
        .groupBy("p", "q", F.pmod(F.xxhash64("fp"), "parts").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))  # about ``tile`` different values, hash-split
    )
    steps = [(x, y) for x in range(radius + 1) for y in range(-radius, radius + 1) if x + abs(y) <= radius and (x > 0 or y >= 0)]
    left = tiles.select(
        F.col("part").alias("a_part"), F.col("fps").alias("a"), F.col("p").alias("a_p"), F.col("q").alias("a_q"),
        F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps])).alias("d"),
    ).select("a", "a_part", "d", (F.col("a_p") + F.col("d.x")).alias("p"), (F.col("a_q") + F.col("d.y")).alias("q"))
    home = (F.col("d.x") == 0) & (F.col("d.y") == 0)
    pairs = left.join(tiles, ["p", "q"]).where(~home | (F.col("a_part") <= F.col("part")))
    # The comparisons weigh more than their rows: deal tile pairs evenly, whatever cell they are of.
    deal = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(deal, F.hash("p", "q", "part", "a_part", "d.x", "d.y"))
    pairs = pairs.select("a", F.col("fps").alias("b"), (home & (F.col("a_part") == F.col("part"))).alias("same"))

    def run(batches):
        for t in batches:
            a, b, same = t.columns
            for k in range(t.num_rows):
                u, v = spanning(a[k].values.to_numpy(zero_copy_only=False).view(np.uint64), b[k].values.to_numpy(zero_copy_only=False).view(np.uint64), same[k].as_py(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return bounded(pairs, 64).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id that links reach) of every row."""
    fps = checkpoint(fingerprints(docs, width, seed))
    roots = components(links(fps, radius, tile))
    # One row for each different fingerprint; rows of a hot one meet it through a join that can be split.
    first = fps.groupBy(F.col("fp").alias("k")).agg(F.min("doc_id").alias("least"))
    first = first.join(roots, F.col("k") == F.col("node"), "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    least = first.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpoint(first.join(least, "root").select("k", "component_id"))
    return fps.join(of, F.col("fp") == F.col("k")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
