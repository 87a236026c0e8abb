"""Rules that run over kinds of lines, and texts that are counted in their own row."""

import random

from pyspark.sql import functions as F

from saldo.catalog import decisions as Q
from saldo.operators import classify as K
from saldo.operators import corpus as X
from saldo.operators import decisions as D
from saldo.operators.texts import kinds, with_kinds
from saldo.plans import audit
from saldo.sources import star

LINES = "account long, folio string, line_id string, code string, description string, valor long, bonif long, copago long, provider long"


def found(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_meet_their_kind(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 1, 8), ("a", None, 9), (None, None, 1), (None, 2, 2), ("a", None, 9)], "t string, n long, id long")
    known = kinds(df, ["t", "n"])
    assert known.count() == 4
    named = known.withColumn("u", F.concat_ws("/", F.coalesce("t", F.lit("-")), F.col("n").cast("string")))
    want = found(df.withColumn("u", F.concat_ws("/", F.coalesce("t", F.lit("-")), F.col("n").cast("string"))), "t", "n", "id", "u")
    assert found(with_kinds(df, named, ["t", "n"]), "t", "n", "id", "u") == want == found(with_kinds(df, named, ["t", "n"], few=1), "t", "n", "id", "u")


def test_lines_of_a_kind_are_decided_once(spark, monkeypatch):
    texts = [("3101001", "MEDICAMENTOS CLINICOS"), ("0303001", "EXAMEN DE LABORATORIO"), ("3201001", "GASTOS NO CUBIERTOS: HONORARIO"), (None, None)]
    rows = [(a, f, f"{a}:{f}", *texts[(a + i) % 4], 100 + a, None if a % 11 == 5 else (a % 3) * 10, None if a % 7 == 3 else a % 5 * 20, None if a % 13 == 4 else a % 6) for a in range(200) for i, f in enumerate(["NF", "AO"])]
    lines = spark.createDataFrame(rows, LINES)
    accounts = spark.createDataFrame([(a, ["ASIA", "EUROPE", "AFRICA", None][a % 4]) for a in range(200)], "account long, contract_id string")
    monkeypatch.setattr(star, "settlement_lines", lambda spark, sf: lines)
    monkeypatch.setattr(star, "accounts", lambda spark, sf: accounts)
    seen, tiered = [], D.tiered
    monkeypatch.setattr(D, "tiered", lambda df: seen.append(df.count()) or tiered(df))
    got = Q.decided(spark, "")
    of = lines.join(accounts.withColumnRenamed("contract_id", "contract_hash"), "account")
    p = F.col("provider")
    of = of.withColumns({"features": K.line_features(F.col("code"), F.col("description"), F.col("bonif"), F.col("copago"), p % 4 == 0, p % 3 == 0),
                         "fact_hash": D.line_fingerprint(F.col("code"), F.col("description"), F.col("bonif"), F.col("copago"))})
    kinds_ = of.select("contract_hash", "code", "description", F.signum("bonif"), F.signum("copago"), p % 4 == 0, p % 3 == 0).distinct().count()
    assert seen == [kinds_] and kinds_ < len(rows)
    e = D.fee_evidence(lines, Q.fees(spark, "")).select("line_id", "financial_category")
    rowwise = D.decide(D.precedent_lookup(of, Q.precedents(of)).join(e, "line_id", "left"))
    cols = ["line_id", "features", "fact_hash", "precedent", "category", "confidence", "source"]
    assert found(got, *cols) == found(rowwise, *cols)
    assert {r[0] for r in got.select("source").distinct().collect()} == {"FINANCIERO", "PRECEDENTE", "DOCTRINA", "HEURISTICA"}


def test_texts_are_counted_in_their_own_row(spark):
    rnd = random.Random(5)
    some = lambda vocabulary, n: rnd.choice([" ", "\n ", "\t"]).join(rnd.choice([w, w.upper()]) for w in rnd.choices(vocabulary, k=n))
    tile = "Uno dos tres cuatro cinco seis siete ocho nueve diez once "
    texts = [None, "", "corto", "a b " * 30, "abcdefghijkl " * 19, tile * 4, tile * 5, tile * 9 + "fin", "x " + tile * 6, "a " * 40 + tile, "É Ü ΣΑΣ İ " * 20, "x y " * 60]
    texts += [some(["a", "b"], rnd.randint(15, 90)) for _ in range(40)] + [some([f"palabra{k}" for k in range(rnd.choice([1, 2, 3, 900]))], rnd.randint(18, 80)) for _ in range(60)]
    alone = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    cols = ["doc_id", "top_count", "repeated", "phrase"]
    own = X.repeated_phrases(alone)
    assert found(own, *cols) == found(X._counted_together(alone, 10, 5), *cols) and own.filter("repeated").count() > 5
    # No phrase leaves its row.
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    shared = alone.unionByName(spark.createDataFrame([(6, tile * 5), (7, None), (None, tile * 9), (None, tile * 9), (20, texts[20])], alone.schema))
    assert found(X.repeated_phrases(shared), *cols) == found(X._counted_together(shared, 10, 5), *cols)


def test_ordered_pass_of_the_audit_runs_once(spark, monkeypatch):
    for n in ("account_signals", "hypotheses", "opaque_copago", "active_hypotheses"):
        monkeypatch.setattr(audit.S, n, lambda *a: None)
    structural = spark.createDataFrame([(1, "PANEL GLOBAL", "Z", 900)], "account long, label string, category string, amount long")
    monkeypatch.setattr(audit.S, "structural_findings", lambda *a: structural)
    rows = [(1, "1:NF", "3101001", "MEDICAMENTOS CLINICOS", 1000, ["IC_BREACH"], "A", "DOCTRINA"), (1, "1:AO", "3101002", "MATERIALES", 400, [], "Z", "HEURISTICA"), (1, "1:RF", "0303001", "EXAMEN", 50, [], "B", "HEURISTICA"),
            (2, "2:NF", "0303001", "EXAMEN", 70, [], "B", "HEURISTICA")]
    decided = spark.createDataFrame(rows, "account long, line_id string, code string, description string, copago long, features array<string>, category string, source string")
    events = spark.createDataFrame([(1, True, True), (2, False, False)], "account long, has_surgery boolean, has_stay boolean")
    seen, positioned = [], audit.FO.positioned
    monkeypatch.setattr(audit.FO, "positioned", lambda df: seen.append(optimized(df)) or positioned(df))
    out = audit.audit(decided, None, decided, None, events)
    assert len(seen) == 1 and "_kept" not in seen[0]
    assert "_kept" not in optimized(out["findings"]) and "_kept" not in optimized(out["balance"])
    assert all(r["A"] + r["B"] + r["Z"] + r["OK"] == r["total"] for r in out["balance"].collect()) and out["balance"].count() == 2
    assert dict(found(out["state"], "account", "state"))[2] == "COPAGO_OK_CONFIRMADO"
