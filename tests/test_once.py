"""Work that is done once: a text, a kind of line, a group that one task can hold."""

import random

from pyspark.sql import functions as F

from saldo.operators import contracts as C
from saldo.operators import matching as M
from saldo.operators import sequence
from saldo.operators.texts import by_text
from saldo.plans import matcher

RULES = "contract_id string, rule_id string, pos long, domain string, modality string, pct double, cap_kind string, cap_value double, clinic string, text string"
LINES = "contract_id string, line_id string, domain string, provider_name string, description string, code string, valor long, bonif long, copago long, hospital boolean, account string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def found(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_small_groups_need_no_join(spark):
    rnd = random.Random(3)
    data = [(k, p, rnd.choice([None, 1, 2, 3])) for k in ["a", "b", None] for p in rnd.sample(range(60), 25)] + [("c", None, 5), ("c", 4, 6)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    v = F.col("v")
    state = dict(sums={"s": v}, lasts={"l": v}, nexts={"n": v}, before={"b": v}, after={"f": v}, priors={"p": v}, follows={"o": v})
    cols = ["k", "pos", "v", *"slnbfpo"]
    small = df.filter("k in ('a', 'b')")
    one = sequence.carry(small, ["k"], ["pos"], sequence.by_pos("pos", 8), **state)
    assert "Join" not in optimized(one)
    assert found(one, *cols) == found(sequence.carry(small, ["k"], ["pos"], sequence.by_pos("pos", 8), **state, whole=0), *cols)
    # Groups without a key or a chunk go on as they were.
    assert found(sequence.carry(df, ["k"], ["pos"], sequence.by_pos("pos", 8), **state), *cols) == found(sequence.carry(df, ["k"], ["pos"], sequence.by_pos("pos", 8), **state, whole=0), *cols)
    mixed = sequence.carry(df.union(spark.createDataFrame([("z", p, p) for p in range(90)], df.schema)), ["k"], ["pos"], sequence.by_pos("pos", 8), **state, whole=40)
    assert found(mixed.filter("k = 'z'"), "pos", "s") == sorted([(p, p * (p + 1) // 2) for p in range(90)], key=repr)


def test_texts_few_or_many(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("B", 3), ("a", 4)], "t string, n int")
    up = {"u": F.upper("t")}
    assert found(by_text(df, ["t"], up), "t", "n", "u") == found(by_text(df, ["t"], up, few=1), "t", "n", "u") == found(df.withColumns(up), "t", "n", "u")


def test_bundle_words_read_a_text_once(spark):
    pool = spark.createDataFrame([("a", 1, 50, "SET DE ASEO"), ("a", 2, 70, "Aseo")], "account string, pos long, total long, description string")
    # In the filter and in the list of words.
    once = optimized(pool.select(M.normalize_strict(F.col("description")))).count("regexp_replace(")
    assert optimized(M.bundle_anchors(pool)).count("regexp_replace(") <= 2 * once


def test_run_candidates_at_range_borders(spark):
    rnd = random.Random(9)
    its = [("a", p, rnd.randint(0, 9)) for p in range(1, 40)]
    items = spark.createDataFrame(its, "account string, pos long, total long")
    lines = [("a", f"l{v}", v) for v in (1, 15, 16, 17, 31, 48)]
    totals = [t for _, _, t in its]
    want = []
    for _, line, v in lines:
        for i in range(len(totals)):
            j = next((j for j in range(i, len(totals)) if abs(sum(totals[i : j + 1]) - v) < 2), None)
            if j is not None:
                want.append((line, i + 1, j + 1))
    got = M.contiguous_candidates(spark.createDataFrame(lines, "account string, line_id string, valor long"), items)
    assert found(got, "line_id", "first", "last") == sorted(want, key=repr)
    # A start is one or two rows, not one for each of the three sums.
    assert "explode(array_distinct(" in optimized(got)


def test_sets_are_scored_in_one_pass(spark):
    items = spark.createDataFrame([("a", 1, 5, "PABELLON", "ASEO"), ("a", 2, 7, "FARMACIA", "SUERO"), ("a", 4, 8, "FARMACIA", "MEDIAS"), ("a", 5, 1, "X", "Y")], "account string, pos long, total long, section string, description string")
    lines = spark.createDataFrame([("a", "l", "1103057", "x", 20, 0, 20)], "account string, line_id string, code string, description string, valor long, bonif long, copago long")
    members = M.run_members(M.contiguous_candidates(lines, items), items)
    out = M.score_candidates(members, lines)
    # Positions 1, 2 and 4 are the first three items in rank; sections are counted over all runs of a set.
    assert found(out, "cand", "size", "run", "sections") == [(1, 3, 2, 2)]
    assert optimized(out).count("Join") <= optimized(members).count("Join") + 1


def rules(spark):
    return spark.createDataFrame([("c", "R1", 1, "EXAMENES", "preferente", 90.0, "SIN_TOPE_EXPRESO", None, "ALFA", "examenes"), ("c", "R2", 2, "HONORARIOS", "preferente", 60.0, "CLP", 50.0, "", "honorarios"),
                                  ("c", "R3", 3, "HOSPITALIZACION", "preferente", 70.0, "CLP", 900.0, "", "hospitalizacion"), ("d", "R4", 4, "HOSPITALIZACION", "preferente", 80.0, "CLP", 900.0, "", "hospitalizacion")], RULES)


def test_lines_meet_the_rules_once(spark):
    mk = lambda c, i, hospital=False: (c, i, "EXAMENES", "P", "examen", "0303001", 100, 40, 60, hospital, "a")
    lines = spark.createDataFrame([mk("c", "l1"), mk("d", "l2"), mk("e", "l3"), mk("c", "l4", None), mk("c", "l5"), mk("d", "l5"), mk("c", None)], LINES)
    alt = C.alternative_check(lines, rules(spark))
    both = C.checked_both_ways(lines, rules(spark))
    cols = ["line_id", "rule_id", "check_state", "alt_domain", "alt_pct", "alt_copago"]
    apart = C.check_payment(C.choose_rules(lines, rules(spark))).join(alt, "line_id")
    assert found(both, *cols) == found(apart, *cols)
    assert [r for r in found(both, "line_id", "rule_id", "alt_domain", "alt_copago") if r[0] in ("l1", "l2", "l3", "l4")] == [
        ("l1", "R1", "HONORARIOS", 50.0), ("l2", None, "HOSPITALIZACION", 20.0), ("l3", None, None, None), ("l4", None, "HONORARIOS", 50.0)]
    # Two rows of l5, one of them with fees, both with hospitalization: 2 rows x 2 rows x 1 x 2.
    assert found(alt.filter("line_id = 'l5'"), "alt_domain") == [("HONORARIOS",)] * 4 and found(alt.filter("line_id is null"), "alt_domain") == [(None,)]
    members = spark.createDataFrame([("l1", "ASEO", "X", 100)], "line_id string, description string, section string, total long")
    events = spark.createDataFrame([("a", True, False)], "account string, has_surgery boolean, has_stay boolean")
    assert optimized(matcher.audit_lines(lines, rules(spark), members, events, F.lit("TRACE_OK"))).count("LogicalRDD [contract_id#") <= 3
