from pyspark.sql import functions as F

from saldo.operators.classify import finding_category


def test_single_event_wording_is_improper(spark):
    rows = [("x", "urgencia luego integrado", "A"), ("x", "Urgencia con hospitalizacion", "A"), ("x", "urgencia sola", "B"), ("insumo", "desglose de urgencia integrado", "A")]
    got = spark.createDataFrame(rows, "g string, t string, want string").where(finding_category(F.col("g"), F.col("t")) != F.col("want")).collect()
    assert got == []
