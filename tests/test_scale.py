"""What a plan must not do at size: throw rows away behind a join, read its input or search twice."""

from pyspark.sql import functions as F

from saldo.operators import balance as B
from saldo.operators import spatial as S
from saldo.operators import subsets
from saldo.sources import settlements


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_footnotes_join_distinct_rows(spark):
    marked = spark.createDataFrame([("k", "ROW", "1", [1, 1, 2]), ("k", "ROW", "1", [1]), ("k", "ROW", "2", [3])], "contract_id string, target_kind string, target_id string, markers array<int>")
    notes = spark.createDataFrame([("k", 1, "a")] * 3 + [("k", 2, "b"), ("k", 2, "c")], "contract_id string, marker int, text string")
    out = S.footnotes(marked, notes, ["contract_id"])
    assert sorted((r["target_id"], r["marker"], r["text"]) for r in out.collect()) == [("1", 1, "a"), ("1", 2, "b"), ("1", 2, "c")]
    above = optimized(out).split("Join")[0]
    assert "Aggregate" not in above


def test_paths_meet_as_distinct_rows(spark):
    refs = spark.createDataFrame([(1, [1, 1, 2]), (1, [2]), (2, [9])], "benefit_id int, path_ids array<int>")
    paths = spark.createDataFrame([(1, 80, ["p", "q"]), (1, 80, ["q", "p"]), (2, 80, ["p"])], "path_id int, pct int, providers array<string>")
    out = S.resolve_paths(refs, paths)
    assert sorted((r["benefit_id"], r["pct"], r["provider"]) for r in out.collect()) == [(1, 80, "p"), (1, 80, "q")]
    above, below = optimized(out).split("Join", 1)
    assert "Aggregate" in above and below.count("Aggregate") == 2


def test_subsets_are_searched_once_a_line(spark):
    c = spark.createDataFrame([("a", "l", 12, 1, 5), ("a", "l", 12, 2, 7), ("a", "l", 12, 3, 12), ("a", "m", 9, 1, 5), ("a", "m", 9, 2, 7)],
                              "account string, line_id string, valor long, pos long, total long")
    out = subsets.subset_of(c, [F.col("pos")])
    assert sorted((r["line_id"], r["pos"], r["total"]) for r in out.collect()) == [("l", 1, 5), ("l", 2, 7)]
    assert optimized(out).count("ArrowEvalPython") == 1


def test_short_search_agrees_with_the_long_one(monkeypatch):
    import random

    rnd = random.Random(5)
    cases = [([rnd.randint(1, 30) for _ in range(rnd.randint(1, 8))], rnd.randint(1, 90)) for _ in range(300)]
    short = [subsets.first_subset(v, t) for v, t in cases]
    monkeypatch.setattr(subsets, "SHORT", 0)
    assert short == [subsets.first_subset(v, t) for v, t in cases] and any(short)


def test_settlement_places_in_one_pass(spark):
    docs = ["""{"account_id": "1", "folios": [{"folioPAM": "F", "prestadorPrincipal": "D", "items": [{"codigo": "a", "valorTotal": "10"}],
               "desglosePorPrestador": [{"nombrePrestador": "P", "items": [{"codigo": "b", "valorTotal": "20"}, {"codigo": "c", "valorTotal": "30"}]}, {"nombrePrestador": "Q"}]},
               {"folioPAM": "G", "items": [{"codigo": "d"}]}, {"folioPAM": "H", "desglosePorPrestador": [{"items": [{"codigo": "e"}]}]}]}"""]
    raw = spark.createDataFrame([(d,) for d in docs], "j string").select(F.from_json("j", settlements.SETTLEMENT).alias("p")).select("p.*")
    out = settlements.flatten_settlement(raw)
    got = sorted((r["folio"], r["provider_no"], r["item_no"], r["provider"] or "", r["code"]) for r in out.collect())
    assert got == [("F", -1, 0, "D", "a"), ("F", 0, 0, "P", "b"), ("F", 0, 1, "P", "c"), ("G", -1, 0, "", "d"), ("H", 0, 0, "", "e")]
    assert "Union" not in optimized(out)


def test_families_read_texts_once(spark):
    f = spark.createDataFrame([("a", 1, "MEDICAMENTO CAMA", "x", "A", 100), ("a", 2, "MEDICAMENTO CAMA", "x", "Z", 150), ("a", 3, "CAMA", "x", "Z", 90), ("b", 1, "CAMA", "x", "Z", 50)],
                              "account string, pos long, label string, rationale string, category string, amount long")
    out = B.net_families(f)
    # The second family goes on from what the first one left: 150 - 100 = 50 of line 2, then 50 of line 3.
    assert sorted((r["account"], r["pos"], r["amount"]) for r in out.collect()) == [("a", 1, 100), ("a", 3, 40), ("b", 1, 50)]
    narrow = optimized(out.select("account", "pos", "category", "amount"))
    assert sum("RLIKE" in x for x in narrow.splitlines()) < 20 and narrow.count("LeftOuter") < 20
