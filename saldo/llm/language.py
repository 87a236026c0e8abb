"""Language identification by nearest centroids.

A text is the TF-IDF vector of its hashed byte 2- and 3-grams, normalised. Document frequencies are counted over all training rows. Each language
has several centroids, found by spherical k-means on a sample of about ``SAMPLE`` of its training rows, drawn by a hash of the id. A text gets the
language of the centroid with the largest cosine. It is rejected if it has no letter, or if the cosine lies under ``SLACK`` times the low
quantile ``LOW`` of the language's sample rows of about the same length (else the next shorter one): too far from everything that was
learned. For that a sample row is held against centroids fitted without it (``FOLDS``), and lengths are pooled to ``POOL`` rows.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing could be learned. Null languages are not
learned. A null doc_id is not held out. Ties go to the language first in order. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from saldo.llm.common import bounded, buffers
from saldo.session import checkpoint

#: Buckets of hashed grams; centroids of a language; rows of a language's sample, about; languages at most.
BUCKETS, CENTROIDS, SAMPLE, LANGUAGES = 4096, 4, 1000, 1000
SLACK, LOW, FOLDS, POOL = 0.5, 0.01, 5, 50
#: Letters lower-cased, other ASCII as one blank.
CHARS = np.arange(256, dtype=np.uint8)
CHARS[65:91] += 32
CHARS[[b for b in range(128) if not chr(b).isalpha()]] = 32
ASCII_LETTER = re.compile("[A-Za-z]")


def counts(texts, buckets: int = BUCKETS) -> np.ndarray:
    """Grams of each text by bucket, float32."""
    data, at = buffers(texts)
    c = CHARS[data].astype(np.uint32)
    out = np.zeros((len(at) - 1, buckets), np.float32)
    for k in range(len(at) - 1):
        for lo in range(int(at[k]), int(at[k + 1]), 1 << 20):  # long texts in pieces that overlap
            x = c[lo : min(lo + (1 << 20) + 2, int(at[k + 1]))]
            two = (x[:-1] << np.uint32(8) | x[1:]) + np.uint32(1 << 24)
            three = two[:-1] << np.uint32(8) | x[2:]
            whole = lo + (1 << 20) + 2 <= at[k + 1]
            for g in (two[:-1] if whole else two, three):
                h = (g * np.uint32(2654435761)) >> np.uint32(20)
                out[k] += np.bincount(h % np.uint32(buckets), minlength=buckets)
    return out


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts(texts, len(idf))) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def length_class(n: np.ndarray) -> np.ndarray:
    """Powers of two of a text's bytes."""
    return np.log2(np.maximum(n, 1)).astype(np.int64)


@dataclass
class Model:
    """Bounded: at most LANGUAGES x CENTROIDS x BUCKETS numbers."""

    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[tuple[str, int], float]

    def bound(self, lang: str, size: int) -> float:
        """The least cosine of a length; of a length not learned, that of the next shorter one, as cosines grow with length."""
        return next((self.least[lang, k] for k in range(size, -1, -1) if (lang, k) in self.least), 0.0)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, of each text."""
        n = len(texts)
        lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
        for lo in range(0, n, 64):
            some = texts.slice(lo, 64)
            has = [t is not None and bool(ASCII_LETTER.search(t) or any(map(str.isalpha, t))) for t in some.to_pylist()]
            if not self.languages:
                continue
            size = length_class(np.diff(buffers(some)[1]))
            sims = vectors(some, self.idf) @ self.centroids.T
            best = sims.argmax(axis=1)
            for k, ok in enumerate(has):
                if ok:
                    name = self.languages[best[k]]
                    lang[lo + k], score[lo + k] = name, min(1.0, max(0.0, float(sims[k, best[k]])))
                    rejected[lo + k] = score[lo + k] < self.bound(name, int(size[k]))
        return lang, score, rejected


def training(docs: DataFrame) -> DataFrame:
    """text and lang of the rows that may be learned from."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fitted(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means, seeded by the row farthest from the centroids so far."""
    c = x.mean(axis=0, keepdims=True)
    c = x[[int((x @ c.T).argmax())]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[int((x @ c.T).max(axis=1).argmin())]])
    for _ in range(rounds):
        of = (x @ c.T).argmax(axis=1)
        c = np.array([x[of == j].sum(axis=0) if (of == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def unseen(x: np.ndarray, k: int) -> np.ndarray:
    """Cosine of each row with centroids fitted on the other folds; equal rows share a fold. NaN if there are no others."""
    fold, out = np.array([zlib.crc32(y.tobytes()) % FOLDS for y in x]), np.full(len(x), np.nan)
    for f in np.unique(fold):
        if (fold != f).any():
            out[fold == f] = (x[fold == f] @ fitted(x[fold != f], k).T).max(axis=1)
    return out


def bounds(cosine: np.ndarray, size: np.ndarray) -> list[tuple[int, float]]:
    """Low quantile of the cosines at each length, of neighbouring lengths pooled from the shortest; what is left joins the last pool."""
    cosine, size = cosine[~np.isnan(cosine)], size[~np.isnan(cosine)]
    pools, n = [[]], 0
    for s in np.unique(size):
        if n >= POOL and (size >= s).sum() >= POOL:
            pools, n = [*pools, []], 0
        pools[-1].append(int(s))
        n += int((size == s).sum())
    return [(s, float(np.quantile(cosine[np.isin(size, p)], LOW))) for p in pools for s in p]


def learn(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, buckets: int = BUCKETS, slack: float = SLACK) -> Model:
    """Fit a model on the training rows of ``docs``."""
    rows = training(docs)

    def frequencies(batches):
        seen, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                seen += (counts(b.column(0).slice(lo, 64), buckets) > 0).sum(axis=0)
            n += b.num_rows
        if n:
            at = np.append(np.flatnonzero(seen), -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], n))], names=["bucket", "n"])

    # At most ``buckets`` + 1 sums.
    sums = bounded(rows.select("text")).mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    by = {r["bucket"]: r["n"] for r in sums}
    total = by.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + by.get(k, 0))) + 0.1 for k in range(buckets)], np.float32)

    size = checkpoint(rows.groupBy("lang").agg(F.count("*").alias("n")))
    if size.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(size), "lang").where(chance < sample / F.col("n"))

    def vectored(batches):
        for b in batches:
            v = np.sqrt(counts(b.column(1), buckets)) * idf
            n = pa.array(np.diff(buffers(b.column(1))[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array([x.astype(np.float16).tobytes() for x in v], pa.binary())], names=["lang", "size", "v"])

    def group(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float16).reshape(t.num_rows, -1).astype(np.float32)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        order = np.lexsort(x[:, :8].T)  # the same centroids whatever order rows come in
        x = x[order]
        c = fitted(x, centroids)
        least = bounds(unseen(x, centroids), length_class(t.column("size").to_numpy())[order])
        lang = t.column("lang")[0].as_py()
        rows = [(lang, j, 0.0, y.astype(np.float32).tobytes()) for j, y in enumerate(c)] + [(lang, -1 - s, slack * y, None) for s, y in least]
        return pa.Table.from_arrays([pa.array(y) for y in zip(*rows)], names=["lang", "no", "least", "c"])

    found = bounded(drawn.select("lang", "text"), 500).mapInArrow(vectored, "lang string, size long, v binary")
    # A group is one language's sample: about ``sample`` rows of 8 KB.
    found = found.groupBy("lang").applyInArrow(group, "lang string, no long, least double, c binary").collect()
    mine = sorted((r["lang"], r["no"], r["c"]) for r in found if r["no"] >= 0)
    c = np.array([np.frombuffer(x, np.float32) for *_, x in mine], np.float32).reshape(len(mine), buckets)
    return Model([x for x, *_ in mine], c, idf, {(r["lang"], -1 - r["no"]): r["least"] for r in found if r["no"] < 0})


def predicted(model: Model, text: Column) -> Column:
    """struct<lang, score, rejected> of a text."""

    def run(texts: pa.Array) -> pa.Array:
        lang, score, rejected = model.predict(texts)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["lang", "score", "rejected"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return F.arrow_udf(run, kind)(text)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row."""
    model = learn(docs)
    out = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", held_out().alias("held_out"), predicted(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))
