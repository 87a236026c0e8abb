"""Operators against plain Python on small random fixtures, and independence of row order."""

import datetime as dt
import random


import pytest
from pyspark.sql import functions as F

from saldo.operators import balance as B
from saldo.operators import contracts as C
from saldo.operators import decisions as D
from saldo.operators import episodes as E
from saldo.operators import findings as FO
from saldo.operators import layout as L
from saldo.operators import matching as M
from saldo.operators import ranges, sequence, spatial, subsets
from saldo.plans import matcher


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def accounts(seed, n_accounts=12, n_items=14, top=12):
    rnd = random.Random(seed)
    return [(f"a{a}", p, f"B_{p:05d}", rnd.randint(1, top)) for a in range(n_accounts) for p in range(1, n_items + 1)]


ITEMS = "account string, pos long, item_id string, total long"


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_carry_is_independent_of_chunks(spark, size):
    rnd = random.Random(5)
    data = [(k, p, rnd.choice([None, None, rnd.randint(1, 9)])) for k in "ab" for p in range(1, 40)]
    df = spark.createDataFrame(rnd.sample(data, len(data)), "k string, p long, v long")
    v = F.col("v")
    got = sequence.carry(df, ["k"], ["p"], sequence.by_pos("p", size), sums={"s": F.coalesce(v, F.lit(0))}, lasts={"l": v}, nexts={"n": v}, before={"b": v}, after={"a": v}, priors={"q": v}, follows={"f": v})
    for k in "ab":
        vs = [x[2] for x in data if x[0] == k]
        have = {r["p"]: r for r in got.filter(F.col("k") == k).collect()}
        for i, x in enumerate(vs):
            r = have[i + 1]
            known = [y for y in vs[: i + 1] if y is not None]
            later = [y for y in vs[i:] if y is not None]
            assert r["s"] == sum(known)
            assert r["l"] == (known[-1] if known else None)
            assert r["n"] == (later[0] if later else None)
            assert r["b"] == (vs[i - 1] if i else None)
            assert r["a"] == (vs[i + 1] if i + 1 < len(vs) else None)
            assert r["q"] == next((y for y in reversed(vs[:i]) if y is not None), None)
            assert r["f"] == next((y for y in vs[i + 1:] if y is not None), None)


def test_contiguous_match(spark):
    data = accounts(1)
    lines = [(f"a{a}", f"a{a}:{t}", t) for a in range(12) for t in (5, 17, 30, 999)]
    got = M.contiguous_match(spark.createDataFrame(lines, "account string, line_id string, valor long"), spark.createDataFrame(data, ITEMS))
    want = []
    for acc, line, t in lines:
        v = [x[3] for x in data if x[0] == acc]
        hit = next(((i, j) for i in range(len(v)) for j in range(i, len(v)) if sum(v[i:j + 1]) == t), None)
        if hit:
            want.append((line, hit[0] + 1, hit[1] + 1))
    assert rows(got, "line_id", "first_pos", "last_pos") == sorted(want)


def closers(vals):
    """Positions and run lengths of items that close open items, one by one."""
    open_, out = [], []
    for i, v in enumerate(vals):
        s, at = 0, None
        for j in range(len(open_) - 1, -1, -1):
            s += open_[j]
            if abs(s - v) < 2:
                at = j
                break
        if at is None:
            open_.append(v)
        else:
            if len(open_) - at > 1:
                out.append((i + 1, len(open_) - at))
            open_ = open_[:at]
    return out


def test_running_subtotals(spark):
    data = accounts(2, top=60)
    got = M.running_subtotals(spark.createDataFrame(data, ITEMS))
    want = [(f"a{a}", p, n) for a in range(12) for p, n in closers([x[3] for x in data if x[0] == f"a{a}"])]
    assert rows(got, "account", "closer_pos", "n") == sorted(want)


@pytest.mark.parametrize("chunk", [1, 3, 700, 8192])
def test_running_subtotals_of_a_long_account(spark, chunk):
    """Five thousand rows (fewer where chunks are tiny) with nested subtotals: every chunk size closes what one stack closes."""
    rnd, rows_ = random.Random(chunk), []
    size = 60 if chunk < 100 else 5000
    while len(rows_) < size:
        part = [rnd.randint(1, 60) for _ in range(rnd.randint(1, 40))]
        rows_ += [*part, sum(part) + rnd.choice([0, 1, -1, 2])] + ([sum(part)] if rnd.random() < 0.3 else [])
    stack, want = [], []
    for p, v in enumerate(rows_):
        total = 0
        for j in range(len(stack) - 1, -1, -1):
            total += stack[j][1]
            if abs(total - v) < 2:
                want += [(q, p) for q, _ in stack[j:]]
                del stack[j:]
                break
        else:
            stack.append((p, v))
    data = spark.createDataFrame([("a", p, v) for p, v in enumerate(rows_)] + [("b", 1, 5), ("b", 2, 5), ("c", 9, 0)], "account string, pos long, total long")
    got = M.closed_items(data, rows=chunk)
    assert rows(got, "account", "pos", "closer_pos") == sorted([("a", *x) for x in want] + [("b", 1, 2)])


def test_subset_indexes():
    import numpy as np

    rnd = random.Random(3)
    for _ in range(200):
        v = np.array([rnd.randint(1, 40) for _ in range(rnd.randint(1, 9))])
        t = rnd.randint(1, 120)
        sums = {0}
        for x in v.tolist():
            sums |= {s + x for s in sums}
        i = subsets.first_subset(v, t)
        assert bool(i) == (t in sums and t > 0)
        if i:
            assert len(set(i)) == len(i) and int(v[i].sum()) == t


def test_subset_search_has_no_item_limit(spark):
    pool = spark.range(1, 401).select(F.lit("a").alias("account"), F.col("id").alias("pos"), F.lit(1).cast("long").alias("total"))
    big = spark.createDataFrame([("b", 1, 1_500_000_001), ("b", 2, 7), ("b", 3, 499_999_999)], "account string, pos long, total long")
    lines = spark.createDataFrame([("a", "l1", 350), ("a", "l2", 401), ("b", "l3", 2_000_000_000), ("b", "l4", 2_000_000_001)], "account string, line_id string, valor long")
    hit = M.subset_match(lines, pool.union(big), [F.col("pos")]).groupBy("line_id").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.sum("total").alias("s"))
    assert rows(hit, "line_id", "n", "d", "s") == [("l1", 350, 350, 350), ("l3", 2, 2, 2_000_000_000)]


def test_large_items_are_split_into_units(spark):
    items = spark.createDataFrame([("a", 1, 21.0, 10, 210), ("a", 2, 5000.0, 2, 10000), ("a", 3, 1.0, 5, 5)], "account string, pos long, qty double, unit_price long, total long")
    assert rows(M.unit_items(items).groupBy("pos").agg(F.count("*").alias("n")), "pos", "n") == [(1, 21), (2, 5000), (3, 1)]


def test_distance_is_null_without_an_anchor_and_any_size_with_one(spark):
    items = spark.createDataFrame([("a", 1, "PABELLON"), ("a", 2_000_001, "GASA"), ("b", 1, "GASA")], "account string, pos long, description string")
    assert rows(M.anchor_distance(items), "account", "pos", "distance") == [("a", 1, 0), ("a", 2_000_001, 2_000_000), ("b", 1, None)]


def test_blocks_reach_past_any_line(spark):
    marks = spark.createDataFrame([("k", n, n in (11_000, 12_000)) for n in range(1, 20_001)], "k string, line_no long, is_point boolean").withColumns(
        {"value": F.lit(1), "is_stop": F.lit(False)})
    b = L.annual_blocks(marks, ["k"])
    assert sorted(tuple(r) for r in b.select("line_no", "first_line", "last_line").collect()) == [(11_000, 0, 11_999), (12_000, 11_001, None)]
    held = spatial.lines_in_blocks(marks.select("k", "line_no"), b.select("k", F.col("line_no").alias("block"), "first_line", "last_line"), ["k"])
    assert held.groupBy("block").count().orderBy("block").collect() == [(11_000, 11_999), (12_000, 9_000)]


def test_deep_trees_with_cycles_and_lost_parents(spark):
    nodes = [(i, i - 1 if i else None) for i in range(40)] + [(100, None), (101, 100), (200, 201), (201, 200), (300, 999)]
    got = spatial.flatten_tree(spark.createDataFrame(nodes, "id long, parent long"))
    assert rows(got, "id", "root", "depth") == [(i, 0, i) for i in range(40)] + [(100, 100, 0), (101, 100, 1)]


def test_amounts_of_any_size(spark):
    from saldo.functions.money import largest_amount, primary_charge

    t = spark.createDataFrame([("total 250.000.000 12",), ("x 5",), ("none",)], "t string")
    assert t.select(largest_amount(F.col("t")).alias("l"), primary_charge(F.col("t")).alias("p")).collect() == [(250_000_000, 250_000_000), (5, 0), (0, 0)]


def test_amount_match_prefers_near_fitting_and_early(spark):
    items = spark.createDataFrame([("a", 1, "B_1", 100, "INSUMOS", "JERINGA"), ("a", 2, "B_2", 50, "", "PABELLON"), ("a", 3, "B_3", 100, "FARMACIA", "PARACETAMOL"), ("a", 9, "B_9", 70, "", "X")],
                                  "account string, pos long, item_id string, total long, section string, description string")
    lines = spark.createDataFrame([("a", "l1", "3101001", "MEDICAMENTOS", 100), ("a", "l2", "3101002", "MATERIALES", 100), ("a", "l3", "9", "OTRO", 70), ("a", "l4", "9", "OTRO", 1)],
                                  "account string, line_id string, code string, description string, valor long")
    m = M.amount_match(lines, M.anchor_distance(items))
    assert rows(m, "line_id", "status", "item_id") == [("l1", "PARTIAL", "B_3"), ("l2", "PARTIAL", "B_1"), ("l3", "OK", "B_9"), ("l4", "FAIL", None)]


def test_containment(spark):
    items = spark.createDataFrame([("a", "B_1", "Jeringa 5 ml larga"), ("a", "B_2", "jeringa 5 ml"), ("a", "B_3", "gasa")], "account string, item_id string, description string")
    lines = spark.createDataFrame([("a", "l1", "JERINGA"), ("a", "l2", "compra jeringa 5 ml azul"), ("a", "l3", "a"), ("a", "l4", "nada")], "account string, line_id string, description string")
    assert rows(M.containment_match(lines, items), "line_id", "item_id") == [("l1", "B_2"), ("l2", "B_2"), ("l3", "B_2")]


def test_episodes_48_hours_inclusive(spark):
    t0 = dt.datetime.fromisoformat("2024-01-01")
    data = [("p", t0), ("p", t0 + dt.timedelta(hours=48)), ("p", t0 + dt.timedelta(hours=97)), ("q", None), ("q", None)]
    n = E.episode_numbers(spark.createDataFrame(data, "provider string, ts timestamp"), ["provider"])
    assert rows(n, "provider", "episode") == [("p", 1), ("p", 1), ("p", 2), ("q", 0), ("q", 0)]


def test_episodes_equal_the_scan(spark):
    rnd = random.Random(8)
    hours = {p: sorted(rnd.randint(0, 2000) for _ in range(40)) for p in "xyz"}
    t0 = dt.datetime.fromisoformat("2024-01-01")
    data = [(p, t0 + dt.timedelta(hours=h)) for p, hs in hours.items() for h in hs]
    got = E.episode_numbers(spark.createDataFrame(rnd.sample(data, len(data)), "provider string, ts timestamp"), ["provider"]).groupBy("provider", "episode").count()
    want = []
    for p, hs in hours.items():
        eps = []
        for h in hs:
            e = next((e for e in eps if abs(h - e[0]) <= 48 or abs(h - e[-1]) <= 48), None)
            if e is None:
                eps.append([h])
            else:
                e.append(h)
        want += [(p, i + 1, len(e)) for i, e in enumerate(eps)]
    assert rows(got, "provider", "episode", "count") == sorted(want)


def test_next_admission(spark):
    t = dt.datetime.fromisoformat("2024-01-01")
    h = lambda n: t + dt.timedelta(hours=n)
    s = spark.createDataFrame([("p", 1, h(0), h(2), True), ("p", 2, h(22), h(90), False), ("p", 3, h(100), h(101), True), ("p", 4, h(126), h(130), False)], "provider string, stay_id long, start timestamp, end timestamp, urgent boolean")
    assert rows(E.next_admission(s, ["provider"]), "stay_id", "admission") == [(1, 2), (3, None)]


def test_waterfall_cuts_z_then_b_then_a(spark):
    s = spark.createDataFrame([("x", 100, 60, 30, 0, 50), ("y", 100, 150, 30, 0, 50), ("z", 100, 10, 0, 5, 5)], "account string, total long, A long, B long, K long, Z long")
    assert rows(B.waterfall(s), "account", "A", "B", "Z", "OK") == [("x", 60, 30, 10, 0), ("y", 100, 0, 0, 0), ("z", 10, 0, 10, 80)]


def test_balance_closes(spark):
    lines = spark.createDataFrame([("a", "l1", 100), ("a", "l2", 50), ("b", "l3", 80)], "account string, line_id string, copago long")
    f = spark.createDataFrame([("a", "l1", "A", 30), ("a", "l1", "Z", 20), ("a", "l2", "A", 80), ("a", "l2", "B", 20)], "account string, line_id string, category string, amount long")
    ok = spark.createDataFrame([("a", "l1", True), ("a", "l2", True), ("b", "l3", False)], "account string, line_id string, allowed boolean")
    stated = spark.createDataFrame([("a", 150), ("b", 80), ("c", 7)], "account string, total long")
    got = rows(B.balance_by_capability(lines, f, ok, stated), "account", "A", "B", "K", "OK", "Z")
    assert got == [("a", 70, 10, 0, 0, 70), ("b", 0, 0, 0, 0, 80), ("c", 0, 0, 0, 0, 7)]


def test_family_netting(spark):
    f = spark.createDataFrame([("a", 1, "MEDICAMENTO X", "", "A", 300), ("a", 2, "MEDICAMENTOS", "", "Z", 200), ("a", 3, "INSUMOS", "", "Z", 250), ("a", 4, "OTRO", "", "Z", 40)],
                              "account string, pos long, label string, rationale string, category string, amount long")
    assert rows(B.net_families(f), "pos", "amount") == [(1, 300), (3, 150), (4, 40)]


def subsume_one_by_one(fs):
    import re

    macro = lambda f: bool(re.search(FO.lx.MACRO_FINDING, f["label"]))
    order = sorted(fs, key=lambda f: (f["category"] != "A", macro(f), -f["amount"], f["pos"]))
    out = []
    for f in order:
        f = dict(f)
        if abs(f["amount"]) < 1:
            continue
        i = next((i for i, o in enumerate(out) if abs(o["amount"] - f["amount"]) < 100), None)
        if i is not None:
            if f["category"] == out[i]["category"] and not macro(f) and re.search(FO.GENERIC_HOLDER, out[i]["label"]):
                out[i] = f
            continue
        if macro(f):
            over = sum(o["amount"] for o in out if re.search(FO.GLOBAL_MACRO, f["label"]) or (f["ref"] and f["ref"] == o["ref"])
                       or (re.search(FO.MATERIAL_MACRO, f["label"]) and re.search(FO.MATERIAL_ITEM, o["label"])))
            if over > 0:
                if f["amount"] - over <= 500:
                    continue
                f["amount"] -= over
        out.append(f)
    return sorted((f["account"], f["finding_id"], f["amount"]) for f in out)


def test_subsumption(spark):
    rnd = random.Random(11)
    labels = ["CUBIERTO PARCIAL", "JERINGA", "MATERIAL X", "OPACIDAD MATERIALES", "RESUMEN GLOBAL", "HOTEL", "AGRUPADOR"]
    fs = [{"account": f"a{a}", "finding_id": f"{a}:{p}", "pos": p, "label": rnd.choice(labels), "category": rnd.choice("ABZ"), "amount": rnd.choice([50, 60, 400, 450, 2000, 2050, 9000, rnd.randint(1, 9000)]), "ref": rnd.choice([None, "PAM:1", "PAM:2"])}
          for a in range(30) for p in range(12)]
    df = spark.createDataFrame([tuple(f.values()) for f in rnd.sample(fs, len(fs))], "account string, finding_id string, pos long, label string, category string, amount long, ref string")
    want = sorted(x for a in range(30) for x in subsume_one_by_one([f for f in fs if f["account"] == f"a{a}"]))
    assert rows(FO.subsume(df), "account", "finding_id", "amount") == want


def test_gap_orphans_equal_one_by_one(spark):
    rnd = random.Random(4)
    ls = [(f"a{a}", p, f"{a}:{p}", rnd.choice([100, 3000, 9000, rnd.randint(1, 20000)]), rnd.random() < 0.8, rnd.random() < 0.1) for a in range(20) for p in range(15)]
    gaps = [(f"a{a}", rnd.randint(0, 40000)) for a in range(20)]
    got = B.gap_orphans(spark.createDataFrame(ls, "account string, pos long, line_id string, copago long, suspicious boolean, caught boolean"), spark.createDataFrame(gaps, "account string, gap long"))
    want = []
    for acc, rest in gaps:
        if rest <= 5000:
            continue
        for x in [x for x in ls if x[0] == acc]:
            if x[4] and not x[5] and x[3] <= rest + 500:
                want.append((x[2], x[3]))
                rest -= x[3]
    assert rows(got, "line_id", "copago") == sorted(want)


def test_matcher_takes_no_item_twice_and_sums_agree(spark):
    rnd = random.Random(21)
    desc = ["PARACETAMOL 500 MG", "JERINGA 5 ML", "SET DE ASEO", "HONORARIO CIRUJANO", "DIA CAMA"]
    its = [(f"a{a}", p, f"B_{p:05d}", rnd.randint(1, 30) * 100, rnd.choice(["FARMACIA", "", "PABELLON"]), rnd.choice(desc)) for a in range(10) for p in range(1, 11)]
    items = spark.createDataFrame(its, "account string, pos long, item_id string, total long, section string, description string")
    lines = []
    for a in range(10):
        mine = [x for x in its if x[0] == f"a{a}"]
        for i, code in enumerate(["3101001", "3101002", "1103057", "3201001"]):
            v = sum(x[3] for x in rnd.sample(mine, rnd.randint(1, 3)))
            lines.append((f"a{a}", f"{a}:{i}", code, f"LINEA {code}", v, 0, v))
    ld = spark.createDataFrame(lines, "account string, line_id string, code string, description string, valor long, bonif long, copago long")
    taken = matcher.match_lines(ld, items).toPandas()
    assert not taken.duplicated(["account", "pos"]).any()
    total = {(x[0], x[1]): x[3] for x in its}
    value = {x[1]: x[4] for x in lines}
    assert len(taken) > 0
    for (line, step), g in taken.groupby(["line_id", "step"]):
        if step != "GLOSA_FAMILIA":
            assert sum(total[(a, p)] for a, p in zip(g["account"], g["pos"])) == value[line]


def test_rule_choice_and_check(spark):
    rules = spark.createDataFrame([("c", "R1", 1, "EXAMENES", "preferente", 90.0, "SIN_TOPE_EXPRESO", None, "ALFA", "examenes preferente"), ("c", "R2", 2, "EXAMENES", "libre_eleccion", 60.0, "CLP", 50000.0, "BETA", "examenes libre"),
                                   ("c", "R3", 3, "OTROS", "preferente", None, "UF", 1.0, "", "otros")],
                                  "contract_id string, rule_id string, pos long, domain string, modality string, pct double, cap_kind string, cap_value double, clinic string, text string")
    mk = lambda i, dom, who, d, v, b: ("c", i, dom, who, d, v, b, v - b, False)
    lines = spark.createDataFrame([mk("l1", "EXAMENES", "Clinica Beta", "examen", 100000, 50000), mk("l2", "EXAMENES", "Gamma", "examen red pref", 100000, 90000), mk("l3", "EXAMENES", "Gamma", "examen", 100000, 50501),
                                   mk("l4", "OTROS", "", "x", 10, 1), mk("l5", "NADA", "", "x", 10, 1), mk("l6", "EXAMENES", "Gamma", "examen", 100000, 49400)],
                                  "contract_id string, line_id string, domain string, provider_name string, description string, valor long, bonif long, copago long, hospital boolean")
    out = C.check_payment(C.choose_rules(lines, rules))
    assert rows(out, "line_id", "rule_id", "matched_by", "check_state") == [
        ("l1", "R2", "KEYWORDS", "VERIFICABLE_OK"), ("l2", "R1", "KEYWORDS", "VERIFICABLE_OK"), ("l3", "R2", "FALLBACK", "VERIFICABLE_OK"), ("l4", "R3", "MODALIDAD", "NO_VERIFICABLE_POR_CONTRATO"),
        ("l5", None, None, "NO_VERIFICABLE_POR_CONTRATO"), ("l6", "R2", "FALLBACK", "INFRA_BONIFICACION")]


def test_doctrine_order(spark):
    f = lambda *x: F.array(*[F.lit(v) for v in x])
    one = lambda c: spark.range(1).select(D.doctrine(c).alias("d")).first()["d"]
    assert one(f("UB_DETECTED", "IC_BREACH"))["rule"] == "C01_INCUMPLIMIENTO_CONTRATO"
    assert one(f("OP_DETECTED", "HT_DETECTED"))["rule"] == "C03_INFERENCIA_TECNICA"
    assert one(f("OP_DETECTED"))["category"] == "Z"
    assert one(f("X")) is None


def test_range_helpers(spark):
    rnd = random.Random(2)
    pts = [("k", i, rnd.uniform(0, 1)) for i in range(60)]
    ivs = [("k", j, a, a + rnd.uniform(0, 0.3)) for j in range(20) for a in [rnd.uniform(0, 1)]]
    p, i = spark.createDataFrame(pts, "k string, p int, x double"), spark.createDataFrame(ivs, "k string, i int, lo double, hi double")
    assert rows(ranges.point_in_interval(p, i, ["k"], "x", "lo", "hi", 0.07), "p", "i") == sorted((q[1], v[1]) for q in pts for v in ivs if v[2] <= q[2] <= v[3])
    o = ranges.interval_overlap(i.withColumnsRenamed({"i": "j", "lo": "a", "hi": "b"}), i, ["k"], ("a", "b"), ("lo", "hi"), 0.07)
    assert rows(o, "j", "i") == sorted((u[1], v[1]) for u in ivs for v in ivs if u[2] < v[3] and u[3] > v[2])


def test_spans_first_cell_wins(spark):
    c = spark.createDataFrame([("p", 1, 0, 0, 2, 2), ("p", 2, 1, 1, 1, 1), ("p", 3, 0, 2, None, None)], "contract_id string, cell_no long, row_index int, col_index int, row_span int, col_span int")
    assert rows(spatial.expand_spans(c, ["contract_id"]), "r", "c", "cell_no", "carried") == [(0, 0, 1, False), (0, 1, 1, True), (0, 2, 3, False), (1, 0, 1, True), (1, 1, 1, True)]


def test_sticky_percent_resets(spark):
    l = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a", "80% x", "b", "ATENCION AMBULATORIA", "c", "70% HOSPITALARIA", "d"])], "contract_id string, line_no long, text string")
    assert [r["pct"] for r in L.sticky_percent(l, ["contract_id"]).orderBy("line_no").collect()] == [90, 80, 80, 80, 90, 70, 90]


def test_row_order_does_not_matter(spark):
    data = accounts(7)
    lines = [(f"a{a}", f"a{a}:{t}", t) for a in range(12) for t in (9, 21)]
    schema = "account string, line_id string, valor long"
    out = set()
    for seed in range(3):
        d = random.Random(seed).sample(data, len(data))
        got = M.contiguous_candidates(spark.createDataFrame(lines, schema), spark.createDataFrame(d, ITEMS).repartition(3))
        out.add(tuple(rows(got, "line_id", "first", "last")))
    assert len(out) == 1


def test_one_row_for_a_gap_that_no_line_explains(spark):
    lines = spark.createDataFrame([("a", 1, "l1", 9000, True, False), ("b", 1, "l2", 4000, True, False), ("c", 1, "l3", 50_000, True, False), ("d", 1, "l4", 10, True, True)],
                                  "account string, pos long, line_id string, copago long, suspicious boolean, caught boolean")
    gaps = spark.createDataFrame([("a", 8600), ("b", 5000), ("c", 6000), ("d", 7000), ("e", 9000)], "account string, gap long")
    assert rows(B.gap_findings(lines, gaps), "account", "code", "line_id", "amount") == [
        ("a", "ORPHAN", "l1", 9000), ("c", "GAP_RECONCILIATION", None, 6000), ("d", "GAP_RECONCILIATION", None, 7000), ("e", "GAP_RECONCILIATION", None, 9000)]
