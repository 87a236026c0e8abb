"""Containment by the rarest group, listings, and a stream that merges into shards."""

import random

from pyspark.sql import functions as F

from saldo.operators import contracts as C
from saldo.operators.containment import contained, either_way
from saldo.streaming import shards


def test_containment_meets_every_pair(spark):
    rnd = random.Random(3)
    left = sorted({"".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 16))) for _ in range(120)} | {"ñandú", "un ñandú gris"})
    right = sorted({t[rnd.randrange(len(t)) :][: rnd.randint(1, 12)] for t in left} | {"zzz", "", "abababababababab"})
    lf, rt = (spark.createDataFrame([(t,) for t in x], "t string") for x in (left, right))
    got = sorted((r["outer"], r["inner"]) for r in contained(lf, rt).collect())
    assert got == sorted((a, b) for a in left for b in right if b and b in a)
    got = sorted((r["left"], r["right"]) for r in either_way(lf, rt).collect())
    assert got == sorted((a, b) for a in left for b in right if b and (b in a or a in b))
    assert contained(lf.limit(0), rt).count() == contained(lf, rt.limit(0)).count() == 0


def test_a_hot_beginning_does_not_make_pairs(spark):
    """Five thousand texts that begin alike: each meets itself and the one short text, not the others."""
    texts = spark.range(5000).select(F.concat(F.lit("HONORARIOS MEDICOS NUMERO "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"))
    got = contained(texts, texts.union(spark.createDataFrame([("004999",)], "t string")))
    assert got.count() == 5001


def test_listing_by_category(spark):
    rows = [("c", 5, "B", "x"), ("c", 1, None, "y"), ("c", 2, "", ""), ("c", 3, "A", "z"), ("d", 1, "A", "w")]
    got = C.coverage_by_category(spark.createDataFrame(rows, "contract_id string, pos long, category string, item string")).orderBy("contract_id", "category_no", "n").collect()
    assert [(r["contract_id"], r["category"], r["category_no"], r["n"], r["text"]) for r in got] == [
        ("c", "SIN CATEGORÍA", 1, 1, "| y | - | - | - | - |  |"), ("c", "SIN CATEGORÍA", 1, 2, "| - | - | - | - | - |  |"), ("c", "A", 2, 1, "| z | - | - | - | - |  |"),
        ("c", "B", 3, 1, "| x | - | - | - | - |  |"), ("d", "A", 1, 1, "| w | - | - | - | - |  |")]


def test_a_stream_rewrites_touched_shards_only(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    schema = "id string, v long, seq long"

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(shards.merge_shards(out, "id", "seq", 8)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    batch([(f"k{i}", i, 1) for i in range(40)] + [("k1", 100, 2)])
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("out/shard=*/*.parquet")}
    assert len({p.parent for p in files}) == 8
    batch([("k3", 7, 1), ("k3", 8, 5), ("new", 1, 1)])
    batch([("k3", 9, 4)])  # late: an earlier row than the table has
    got = {r["id"]: (r["v"], r["created_at"] == r["updated_at"]) for r in spark.read.parquet(out).collect()}
    assert len(got) == 41 and got["k1"][0] == 100 and got["k3"] == (8, False) and got["new"] == (1, True) and got["k0"] == (0, True)
    assert sum(p in files for p in tmp_path.glob("out/shard=*/*.parquet")) >= 6 - 2
