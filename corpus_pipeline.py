"""The training-data pipeline: documents through five stages, each written as Parquet and read again.

1. language: documents whose language is rejected go.
2. near_duplicates: of each group linked by SimHash one row stays, the least by doc_id (null last) and a hash of the text.
3. decontamination: documents that hold a benchmark window go; other texts under the same doc_id stay.
4. personal_data: personal data and discovered identifiers become placeholders.
5. mix: documents with the words that the mix takes of them; those of which it takes none go.

All but the last return the columns of documents. Null texts go in the first stage; empty tables stay empty. Further columns may have
any name and type; they are carried along. The last stage adds taken, in place of an older column of that name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import apportion, identifiers, language, positional, simhash
from saldo.llm.common import bounded, hidden, place, read, shown
from saldo.session import checkpoint, shared_folder


def keyed(docs: DataFrame) -> DataFrame:
    """text, and as doc_id what tells rows apart: the id (null last) and a hash of the text."""
    return docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of")).alias("doc_id"), "text")


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with doc_ids of ``keyed``; a null id matches a null."""
    rows, out = hidden(docs), keys.select(F.col("doc_id.id").alias("id"), F.col("doc_id.of").alias("of"))
    same = rows[f"c{place(docs, 'doc_id')}"].eqNullSafe(out["id"]) & (F.xxhash64(rows[f"c{place(docs, 'text')}"]) == out["of"])
    return shown(rows.join(out, same, how), docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.learn(docs)
    rows = bounded(hidden(docs))
    judged = rows.withColumn("judged", language.predicted(model, F.col(f"c{place(docs, 'text')}").cast("string")))
    return shown(judged.where("NOT judged.rejected"), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(keyed(docs))
    rows = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    odd = checkpoint(rows.where("n > 1 OR NOT stays"))
    # Of rows with the same doc_id and text, the least by their columns as JSON, which orders columns of any type.
    again = hidden(matched(docs, odd.where("stays"), "left_semi"))
    row, keys = F.struct(*again.columns), (f"c{place(docs, 'doc_id')}", F.xxhash64(f"c{place(docs, 'text')}"))
    again = again.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return matched(docs, odd, "left_anti").union(shown(again, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = positional.phrase_matches(positional.Index(keyed(docs), read(spark, sf_dir, "benchmark"), 10))
    return matched(docs, checkpoint(found.select("doc_id").distinct()), "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identifiers.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apportion.mixed(docs)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("mix", mix),
]

#: The learned languages, fingerprints and contexts are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
