"""What queries write to disk: exchanges of a plan, tables of a checkpoint, and the same results in small and large accounts."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from saldo.catalog import text as reports
from saldo.operators import corpus, sequence, subsets
from saldo.operators import matching as M
from saldo.plans import audit, matcher
from saldo.session import checkpoint


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_checkpoint_is_a_table_of_the_same_rows(spark):
    df = spark.range(2000).select("id", F.lit("a text that repeats in every row").alias("t"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("n"), F.array(F.struct("id", F.lit(1.5).alias("x"))).alias("a"))
    kept = checkpoint(df)
    assert len(kept.inputFiles()) > 0 and kept.dtypes == df.dtypes
    assert sorted(kept.collect()) == sorted(df.collect())
    assert checkpoint(df.limit(0)).columns == df.columns and checkpoint(df.limit(0)).isEmpty()
    # Columns that Parquet does not hold.
    assert checkpoint(spark.range(3).select("id", F.lit(None).alias("v"))).count() == 3


def test_block_combinations_deal_rows_by_account_once(spark):
    rnd = random.Random(4)
    blocks = [(a, f"s{i}", rnd.randint(1, 40)) for a in range(30) for i in range(6)] + [(30, None, 5), (30, "x", 7)]
    lines = [(a, f"{a}:{n}", rnd.randint(1, 90)) for a in range(32) for n in range(3)]
    got = M.block_combinations(spark.createDataFrame(lines, "account long, line_id string, valor long"), spark.createDataFrame(blocks, "account long, block string, amount long"))
    assert exchanges(got) <= 3
    want = {}
    for a, line, v in lines:
        mine = sorted((b, x) for p, b, x in blocks if p == a and b is not None)
        fits = [[b for b, _ in c] for k in (1, 2, 3) for c in combinations(mine, k) if abs(sum(x for _, x in c) - v) < 2 and sum(x for _, x in c[:-1]) < v]
        if fits:
            want[line] = min(fits)
    assert {r.line_id: r.parts for r in got.collect()} == want and all(len(r.parts) == r.k for r in got.collect())


def test_subsets_of_small_and_large_accounts(spark):
    rnd = random.Random(7)
    rows = [(a, f"{a}:{n}", sum(t for _, t in items[:3]), p, t) for a in range(20) for items in [[(p, rnd.randint(1, 50)) for p in range(8)]] for n in range(2) for p, t in items]
    c = spark.createDataFrame(rows, "account long, line_id string, valor long, pos long, total long").union(spark.createDataFrame([(None, "x", 5, 1, 5), (1, None, 5, 1, 5)], "account long, line_id string, valor long, pos long, total long"))
    small = subsets.subset_of(c, [F.col("pos")])
    assert "REPARTITION" not in small._jdf.queryExecution().executedPlan().toString()
    one = sorted(small.collect())
    assert one == sorted(subsets.subset_of(c, [F.col("pos")], rows=5).collect()) == sorted(subsets.subset_of(c, [F.col("pos")], few=4, block=64).collect())
    assert {r.line_id for r in one} == {r[1] for r in rows}


def test_equal_subsets_of_later_orders_go(spark):
    rows = [(1, "a", k, p, 10) for k in (0, 1) for p in (1, 2)] + [(1, "a", 2, p, 10) for p in (1, 3)] + [(1, "b", 1, 1, 5), (1, "b", 2, 1, 5), (1, "c", 0, 1, 5), (1, "c", 2, 1, 5), (1, "c", 2, 1, 5)]
    got = M._first_of_equal(spark.createDataFrame(rows, "account long, line_id string, cand int, pos long, total long"), 3)
    assert {(r.line_id, r.cand) for r in got.collect()} == {("a", 0), ("a", 2), ("b", 1), ("c", 0), ("c", 2)} and got.count() == 8


def test_runs_of_small_and_large_accounts(spark, monkeypatch):
    rnd = random.Random(11)
    items = [(a, p, rnd.choice([0, 1, 2, 3, 5])) for a in range(12) for p in range(1, 12)]
    lines = [(a, f"{a}:{n}", rnd.randint(1, 14)) for a in range(13) for n in range(3)]
    pool = spark.createDataFrame(items, "account long, pos long, total long")
    asked = spark.createDataFrame(lines, "account long, line_id string, valor long")
    want = set()
    for a, line, v in lines:
        t = [x for b, _, x in items if b == a]
        for i in range(len(t)):
            j = next((j for j in range(i, len(t)) if abs(sum(t[i : j + 1]) - v) <= 1), None)
            if j is not None:
                want.add((line, i + 1, j + 1))
    found = lambda: {(r.line_id, r.first, r.last) for r in M.contiguous_candidates(asked, pool).collect()}
    assert found() == want
    plan = M.contiguous_candidates(asked, M.prefix_sums(pool))
    assert "_r" not in plan._jdf.queryExecution().executedPlan().toString().replace("_rank", "") or exchanges(plan) <= 3
    monkeypatch.setattr(M, "FEW", 3)
    assert found() == want


def test_rows_are_counted_without_their_position(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 9, "z"), (None, 1, "n")], "account long, page long, t string")
    numbered = sequence.number(df, ["account"], ["page"], F.struct("page"))
    chunk = numbered.withColumn("_c", sequence.by_pos()).filter(F.col("_c").isNull())
    assert "Window" not in numbered.withColumn("_c", sequence.by_pos().isNull()).groupBy("account").agg(F.bool_or("_c"))._jdf.queryExecution().optimizedPlan().toString()
    assert chunk.count() == 0
    pos = spark.createDataFrame([(0,), (8191,), (8192,), (-1,), (None,)], "pos long")
    assert [r[0] for r in pos.select(sequence.by_pos()).collect()] == [0, 0, 1, -1, None]
    assert [r[0] for r in pos.select(sequence.by_pos(rows=100)).collect()] == [0, 81, 81, -1, None]
    few = sequence.number(df, ["account"], ["page"], F.struct("page"), counted=df.limit(0))
    assert sorted((r.t, r.pos) for r in few.collect()) == sorted((r.t, r.pos) for r in numbered.collect())


def test_report_lines_are_dealt_once(spark):
    rows = [(1, 1, " SECTION: A "), (1, 2, "a | b | c | d"), (1, 3, "  "), (1, 4, None), (1, 5, "e | f | g | h"), (2, 1, "i | j | k | l"), (2, 2, "SECTION: B"), (2, 3, "m | n | o")]
    df = spark.createDataFrame(rows, "account long, n long, line string").withColumn("line_no", F.coalesce("n", F.lit(0)))
    out = corpus.sectioned_report(df.drop("n"), "account")
    assert exchanges(out) == 1
    assert sorted((r.account, r.line_no, r.section, r["columns"]) for r in out.collect()) == [(1, 2, "A", list("abcd")), (1, 5, "A", list("efgh")), (2, 1, "GENERAL", list("ijkl"))]


def test_events_and_facts_meet_short_lines(spark, monkeypatch):
    seen, check = [], matcher.C.checked_both_ways
    monkeypatch.setattr(matcher.C, "checked_both_ways", lambda lines, rules: seen.append(set(lines.columns)) or check(lines, rules))
    lines = spark.createDataFrame([(1, "1:a", "3101001", "MEDICAMENTOS", 100, 50, 50, "C", True, "CLINICA", "HONORARIOS"), (2, "2:a", "3101001", "MEDICAMENTOS", 100, 50, 50, "C", True, "CLINICA", "HONORARIOS"),
                                   (None, "3:a", "3101001", "MEDICAMENTOS", 100, 50, 50, "C", True, "CLINICA", "HONORARIOS")],
                                  "account long, line_id string, code string, description string, valor long, bonif long, copago long, contract_id string, hospital boolean, provider_name string, domain string")
    rules = spark.createDataFrame([("C", "R1", 1, "HONORARIOS", "preferente", 80.0, "UF", 5.0, "CLINICA", "HONORARIOS CLINICA")],
                                  "contract_id string, rule_id string, pos long, domain string, modality string, pct double, cap_kind string, cap_value double, clinic string, text string")
    members = spark.createDataFrame([("1:a", "PARACETAMOL", "FARMACIA", 100)], "line_id string, description string, section string, total long")
    events = spark.createDataFrame([(1, True, False)], "account long, has_surgery boolean, has_stay boolean")
    got = matcher.audit_lines(lines, rules, members, events, F.when(F.col("n_items") == 1, "TRACE_OK").otherwise("TRACE_NONE")).collect()
    assert [r.line_id for r in got] == ["1:a"]
    assert {"n_items", "matched_sum", "has_surgery", "has_stay"} <= seen[0]


def test_merged_findings_are_read_from_a_table(spark):
    decided = spark.createDataFrame([(1, "1:a", "3101001", "X", "A", 500, ["F"]), (1, "1:b", "3101001", "Y", "B", 500, ["F"])],
                                    "account long, line_id string, code string, description string, category string, copago long, features array<string>")
    structural = spark.createDataFrame([(1, "X", "A", 450), (1, "X", "B", 900), (1, "Z", "B", 500)], "account long, label string, category string, amount long")
    got = audit.merged_findings(decided, structural)
    assert got.inputFiles() and "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.label, r.amount, r.source) for r in got.collect()) == [("X", 500, "decision"), ("X", 900, "structural"), ("Z", 500, "structural")]


def test_titles_and_rows_of_a_report_come_from_one_pass(spark, monkeypatch):
    items = spark.createDataFrame([(1, 1, 1, "A", "x", 2.0, 10, 3), (1, 2, 2, "B", "y", 1.0, 20, 4), (1, 3, 3, "", "z", 1.0, 30, 5), (2, 1, 2, "C", "w", 1.0, 40, 6)],
                                  "account long, pos long, page int, section string, description string, qty double, total long, copago long")
    monkeypatch.setattr(reports.star, "bill_items", lambda spark, sf: items)
    out = reports.s07(spark, "")
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.account, r.line_no, r.section, r["columns"]) for r in out.collect()) == [
        (1, 3, "A", ["x", "2", "10", "3"]), (1, 5, "A", ["y", "1", "20", "4"]), (1, 7, "A", ["z", "1", "30", "5"]), (2, 3, "GENERAL", ["w", "1", "40", "6"])]
