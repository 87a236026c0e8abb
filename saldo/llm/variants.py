"""Spelling variants of a corpus' words, by a trie of letter counts.

A word's vector counts its letters group by group (``GROUPS``, then all others). Words stand in a trie that branches by one count
a level. One inserted, deleted or replaced letter adds at most one to one count and takes at most one from another, so a word's
near words lie where a depth-first search with a budget of one surplus and one deficit arrives; what stands there is verified.

The trie is cut where a node holds at most ``shard`` words; searches walk the levels above the cut as joins of (vector,
node) rows, below it within the shard. A shard is held by one task at a time, words to be looked up stream past it; one that
many look up is dealt to several tasks, and a leaf above the bound is split. Words of one leaf differ only by the order of letters.

A word's form is its near word that occurs most (of equals the first in code-point order), if it occurs at least twice as
often; its root ends the chain of forms. Counts at least double along a chain, so it is as long as their logarithm at most, and is
followed by doubling. Null texts hold no words; rows that repeat a doc_id count as often as they stand; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.common import bounded
from saldo.session import checkpoint

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Letters that share a level of the trie.
GROUPS = ("e", "a", "i", "o", "t", "n", "s", "r", "l", "h", "d", "u", "cm", "pf", "gyb", "wvkxjqz", "àäéíñü", "áèêçóö")
LEVELS = len(GROUPS) + 1
#: Words of a shard, words looked up in one task, letters of words that are compared as arrays.
SHARD, QUERIES, SHORT = 20_000, 100_000, 40


def counted(docs: DataFrame, least_letters: int = 5, least_count: int = 3, change: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z lower-cased: those of enough letters and occurrences.

    ``change`` gets each different run of a text with its doc_id and may correct it.
    """

    def run(batches):
        for b in batches:
            words: Counter = Counter()
            for d, t in zip(b.column(0), b.column(1)):
                text = (t.as_py() or "").encode().lower().decode()
                found = Counter(map(re.Match.group, RUN.finditer(text)))
                if change is None:
                    words.update(found)
                    continue
                doc_id = d.as_py()
                for w, n in found.items():
                    words[change(doc_id, w)] += n
            kept = [w for w in words if len(w) >= least_letters]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array([words[w] for w in kept], pa.int64())], names=["word", "n"])

    parts = bounded(docs.select("doc_id", F.col("text").cast("string"))).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def vector(word: Column) -> Column:
    """Letters of a word by group, the last for all that are in none."""
    counts = [F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS]
    rest = F.length(word)
    for c in counts:
        rest = rest - c
    return F.array(*counts, rest)


def cut(words: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """(homes, routes): the shard and weight each vector stands in, and the shards where each vector's search arrives.

    words: word, v. Shards are named by their node, a level's counts joined by commas.
    """
    vectors = checkpoint(words.groupBy("v").agg(F.count("*").alias("w")))
    open_ = vectors.withColumn("at", F.lit(""))
    states = vectors.select("v", F.lit("").alias("at"), F.lit(1).alias("more"), F.lit(1).alias("less"))
    homes = routes = None
    for level in range(LEVELS):
        count = F.col("v")[level]
        join = lambda c: F.concat_ws(",", F.when(F.col("at") != "", F.col("at")), c.cast("string"))
        open_ = checkpoint(open_.withColumn("at", join(count)))
        nodes = open_.groupBy("at").agg(F.sum("w").alias("weight"))
        nodes = checkpoint(nodes.withColumn("done", (F.col("weight") <= shard) | F.lit(level == LEVELS - 1)))
        steps = F.array(
            F.struct(join(count).alias("at"), F.col("more").alias("more"), F.col("less").alias("less")),
            F.when(F.col("more") > 0, F.struct(join(count + 1).alias("at"), (F.col("more") - 1).alias("more"), F.col("less").alias("less"))),
            F.when((F.col("less") > 0) & (count > 0), F.struct(join(count - 1).alias("at"), F.col("more").alias("more"), (F.col("less") - 1).alias("less"))),
        )
        walked = states.select("v", F.explode(F.array_compact(steps)).alias("s")).select("v", "s.*")
        walked = checkpoint(walked.join(nodes.select("at", "done"), "at").select("v", "at", "more", "less", "done"))
        here = open_.join(nodes, "at").select("v", "at", "weight", "done")
        home, route = here.where("done").select("v", "at", "weight"), walked.where("done").select("v", "at")
        homes, routes = (home, route) if homes is None else (homes.unionByName(home), routes.unionByName(route))
        open_ = open_.join(nodes.where("NOT done").select("at"), "at", "left_semi").select("v", "w", "at")
        states = walked.where("NOT done").drop("done")
        if nodes.where("NOT done").isEmpty():
            break
    return homes, routes


def one_edit(a: str, b: str) -> bool:
    """Do two words differ by exactly one inserted, deleted or replaced letter?"""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Trie:
    """The words of one shard in the order of their vectors, so that a node is a range of rows."""

    def __init__(self, words: list[str], counts: np.ndarray, n: list[int]):
        order = np.lexsort(counts.T[::-1])
        self.counts = counts[order]
        self.words = [words[i] for i in order.tolist()]
        self.n = np.array(n, np.int64)[order]
        self.letters = spelled(self.words)

    def arrivals(self, counts: np.ndarray):
        """(query, word) number pairs within the budget: depth-first over nodes, each with the queries that still live there."""
        q = len(counts)
        stack = [(0, len(self.words), 0, np.arange(q), np.ones(q, np.int8), np.ones(q, np.int8))]
        while stack:
            lo, hi, level, alive, more, less = stack.pop()
            if lo == hi or not len(alive):
                continue
            if level == LEVELS or (hi - lo) * len(alive) <= 2048:
                # Few enough to walk the levels that are left for all pairs at once, some thousand at a time.
                step = max(1, 4096 // (hi - lo))
                for k in range(0, len(alive), step):
                    some = alive[k : k + step]
                    d = self.counts[lo:hi, None, level:] - counts[None, some, level:]
                    fits = (np.maximum(d, 0).sum(axis=2) <= more[k : k + step]) & (np.maximum(-d, 0).sum(axis=2) <= less[k : k + step])
                    i, j = np.nonzero(fits)
                    if len(i):
                        yield some[j], i + lo
                continue
            column = self.counts[lo:hi, level]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
            mine = counts[alive, level]
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                d = column[a] - mine
                ok = (d == 0) | ((d == 1) & (more > 0)) | ((d == -1) & (less > 0))
                if ok.any():
                    d = d[ok]
                    stack.append((lo + a, lo + b, level + 1, alive[ok], more[ok] - (d == 1), less[ok] - (d == -1)))

    def near(self, words: list[str], counts: np.ndarray):
        """(query, word) number pairs of words that differ by one letter."""
        letters, held, size = spelled(words), [], 0
        for pair in self.arrivals(counts):
            held.append(pair)
            size += len(pair[0])
            if size >= 1 << 14:
                yield from self.judged(words, letters, held)
                held, size = [], 0
        yield from self.judged(words, letters, held)

    def judged(self, words: list[str], letters, held: list):
        if not held:
            return
        i, j = (np.concatenate(x) for x in zip(*held))
        for k in range(0, len(i), 1 << 15):
            yield verified(words, letters, i[k : k + (1 << 15)], self.words, self.letters, j[k : k + (1 << 15)])


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points from the front and from the back, of words up to ``SHORT`` letters; longer ones have length -1."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    front = np.array(words, f"<U{SHORT + 1}").view(np.uint32).reshape(len(words), SHORT + 1)
    place = size[:, None] - 1 - np.arange(SHORT + 1)
    back = np.where(place >= 0, np.take_along_axis(front, np.clip(place, 0, SHORT), axis=1), 0)
    return np.where(size <= SHORT, size, -1), front, back


def verified(a_words, a, i, b_words, b, j) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (i of a, j of b) that differ by exactly one letter: common beginning and end leave one letter of the longer word."""
    n, m = a[0][i], b[0][j]
    both = (n >= 0) & (m >= 0)
    least, most = np.minimum(n, m), np.maximum(n, m)
    common = [np.minimum(np.argmin(np.concatenate([x[i] == y[j], np.zeros((len(i), 1), bool)], axis=1), axis=1), least) for x, y in zip(a[1:], b[1:])]
    ok = both & (most - least <= 1) & (common[0] + common[1] >= most - 1) & ~((n == m) & (common[0] == n))
    for k in np.flatnonzero(~both).tolist():
        ok[k] = one_edit(a_words[i[k]], b_words[j[k]])
    return i[ok], j[ok]


def near_pairs(words: DataFrame, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(word, near, near_n): both directions of all pairs that differ by one letter. words: word (each once), n, v; written rows."""
    homes, routes = cut(words.select("word", "v"), shard)
    homes, routes = checkpoint(homes), checkpoint(routes)
    blocks = homes.select("at", F.ceil(F.col("weight") / shard).cast("int").alias("blocks")).distinct()
    asked = routes.join(words.groupBy("v").agg(F.count("*").alias("w")), "v").groupBy("at").agg(F.ceil(F.sum("w") / queries).cast("int").alias("parts"))
    tiles = checkpoint(blocks.join(asked, "at"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    entries = words.join(homes.select("v", "at"), "v").join(tiles, "at").select("at", mine.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"), "word", "n", "v")
    dealt = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    lookups = words.join(routes, "v").join(tiles, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), dealt.alias("part"), F.lit(1).alias("asks"), "word", "n", "v")
    rows = entries.unionByName(lookups).withColumn("tile", F.concat_ws("|", "at", "block", "part"))
    rows = rows.repartition("tile").sortWithinPartitions("tile", "asks").select("tile", "asks", "word", "n", "v")

    def run(batches):
        # A tile's entries come before its lookups; only the entries are held.
        now, words_, n_, v_, trie = None, [], [], [], None
        for b in batches:
            text, n = b.column(2).to_pylist(), b.column(3).to_pylist()
            counts = np.asarray(b.column(4).flatten()).reshape(-1, LEVELS).astype(np.int32)
            out: list[list] = [[], [], []]
            # Stretches of one tile and kind.
            rows_ = b.num_rows
            turns = np.zeros(max(0, rows_ - 1), bool)
            for c in (b.column(0), b.column(1)):
                turns |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, max(0, rows_ - 1))))
            starts = [0, *(np.flatnonzero(turns) + 1).tolist()] if rows_ else []
            for lo, hi in zip(starts, [*starts[1:], rows_]):
                tile, ask = b.column(0)[lo].as_py(), b.column(1)[lo].as_py()
                if tile != now:
                    now, words_, n_, v_, trie = tile, [], [], [], None
                if not ask:
                    words_ += text[lo:hi]
                    n_ += n[lo:hi]
                    v_.append(counts[lo:hi])
                    continue
                if trie is None:
                    trie = Trie(words_, np.concatenate(v_) if v_ else np.zeros((0, LEVELS), np.int32), n_)
                for i, j in trie.near(text[lo:hi], counts[lo:hi]):
                    out[0] += [text[lo + k] for k in i.tolist()]
                    out[1] += [trie.words[k] for k in j.tolist()]
                    out[2] += trie.n[j].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["word", "near", "near_n"])

    return bounded(rows, 20_000).mapInArrow(run, "word string, near string, near_n long")


def variants(words: DataFrame, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of (word, n); words are different and not null."""
    words = checkpoint(words.select("word", "n", vector(F.col("word")).alias("v")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = near_pairs(words, shard, queries).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    joined = words.join(found, "word", "left")
    has = -F.col("b.n") >= 2 * F.col("n")
    forms = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("b.word")).alias("form"), F.when(has, -F.col("b.n")).alias("form_n")))
    roots = checkpoint(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = checkpoint(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
