"""Readers, sinks, stores and streams through files."""

import json

from pyspark.sql import functions as F

from saldo.sources import bills, contracts, settlements, stores
from saldo.streaming import merge, sessions


def put(path, *docs):
    path.mkdir(parents=True, exist_ok=True)
    for i, d in enumerate(docs):
        (path / f"d{i}.json").write_text(json.dumps(d))
    return str(path)


ITEM = {"index": "1", "description": "JERINGA", "quantity": "2", "unitPrice": "1.500", "total": "3.000"}


def test_bill_wrappings(spark, tmp_path):
    docs = [{"account_id": "a", "content": json.dumps({"items": [ITEM]})}, {"account_id": "b", "data": {"sections": [{"category": "PAB", "items": [ITEM]}]}}, {"account_id": "c", "items": [ITEM]},
            {"account_id": "d", "rows": [{"rawText": "x", "total": "5"}]}, {"account_id": "e", "sections": [{"category": "FAR", "items": [ITEM, ITEM]}]}]
    got = bills.flatten_bill(bills.read_bills(spark, put(tmp_path / "b", *docs)))
    assert sorted((r["account_id"], r["section"], r["description"], r["total"]) for r in got.collect()) == [
        ("a", "", "JERINGA", 3000), ("b", "PAB", "JERINGA", 3000), ("c", "", "JERINGA", 3000), ("d", "", "x", 5), ("e", "FAR", "JERINGA", 3000), ("e", "FAR", "JERINGA", 3000)]


def test_settlement_two_places(spark, tmp_path):
    line = {"codigo": "1101001", "glosa": "X", "valorTotal": "$1.000", "bonificacion": "600", "copago": 400, "fecha": "31/12/2024"}
    doc = {"account_id": "a", "folios": [{"folioPAM": "7", "prestadorPrincipal": "P", "items": [line], "desglosePorPrestador": [{"nombrePrestador": "Q", "items": [line, line]}], "resumen": {"totalCopagoDeclarado": "1.200"}}]}
    raw = settlements.read_settlements(spark, put(tmp_path / "s", doc))
    l = settlements.flatten_settlement(raw)
    assert sorted((r["provider"], r["code"], r["valor"], r["copago"], r["ts"].day) for r in l.collect()) == [("P", "1101001", 1000, 400, 31), ("Q", "1101001", 1000, 400, 31), ("Q", "1101001", 1000, 400, 31)]
    assert settlements.drop_duplicates(l).count() == 2
    assert settlements.declared_totals(raw).first()["declared_copago"] == 1200


def test_contract_packages(spark, tmp_path):
    d = tmp_path / "p"
    d.mkdir()
    (d / "audit_package_PLAN UNO_v1.5.0.json").write_text(json.dumps({"assignments": [{"row_id": "R_DIA_CAMA", "column_id": "COL_PREF_PCT", "atoms": [{"value": "90", "unit": "%"}]}]}))
    (d / "audit_package_DOS_v1.5.0.json").write_text(json.dumps({"coberturas": [{"item": "Consulta", "tipo_modalidad": "preferente", "porcentaje": "80%", "tope": "2 UF"}]}))
    r = contracts.contract_rules(contracts.read_packages(spark, str(d / "audit_package_*.json")))
    assert sorted((x["contract_id"], x["dialect"], x["benefit"], x["pct"]) for x in r.collect()) == [("DOS", "CANONICAL", "Consulta", 80.0), ("PLAN UNO", "PACKAGE", "DIA CAMA", 90.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("c1", "x", 1), ("c2", "y", 2)], "contract_id string, t string, n long")
    stores.write_reports(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    stores.write_report_text(df, str(tmp_path / "t"), ["t", "n"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["| x | 1 |", "| y | 2 |"]
    stores.write_packages(df, str(tmp_path / "k"))
    assert (tmp_path / "k" / "contract_id=c1").is_dir()
    assert stores.add_content(df, "t", str(tmp_path / "c")).count() == 2
    again = spark.createDataFrame([("c1", "x", 1), ("c3", "z", 3)], df.schema)
    stores.add_content(again, "t", str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 3


def test_stream_merge_and_sessions(spark, tmp_path):
    src = tmp_path / "in"
    schema = "id string, v long, seq long"
    out = str(tmp_path / "out")

    def batch(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(merge.merge_batches(out, "id", "seq")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    batch([("a", 1, 1), ("b", 5, 1), ("a", 2, 2)])
    batch([("b", 6, 3), ("c", 7, 3)])
    assert sorted((r["id"], r["v"]) for r in merge.current(spark, out).collect()) == [("a", 2), ("b", 6), ("c", 7)]

    ev = tmp_path / "ev"
    spark.sql("select 'p' as k, timestamp '2024-01-01 00:00:00' as ts union all select 'p', timestamp '2024-01-03 00:00:00' union all select 'p', timestamp '2024-01-05 01:00:00' union all select 'z', timestamp '2025-01-01'").coalesce(1).write.parquet(str(ev))
    s = sessions.session_episodes(spark.readStream.schema("k string, ts timestamp").parquet(str(ev)), "k")
    q = s.writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["events"] for r in spark.sql("select * from sess where k = 'p'").collect()) == [1, 2]
