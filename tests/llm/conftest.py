import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text[, lang[, source]]) rows, with columns whose names clash with inner ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(3)
        for c in ("term", "pos", "fp", "block", "key", "size", "token", "row", "n_words", "taken", "spans", "stratum"):
            df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
