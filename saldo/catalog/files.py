"""Queries through real files: reports and packages written and read back, package folders, keyed tables fed by a stream, listings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from saldo.catalog.base import DESCRIBED, LINES
from saldo.catalog.registry import query
from saldo.operators import contracts as C
from saldo.session import shared_folder
from saldo.sources import contracts, star, stores
from saldo.streaming import shards


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("k01_reports", f"WITH {LINES} SELECT line_id, code, valor, '| ' || line_id || ' | ' || code || ' | ' || valor || ' |' AS text FROM lines")
def k01(spark, sf):
    """Settlement lines as JSON rows and as table rows of text, both read again and brought together."""
    lines, at = star.settlement_lines(spark, sf).select("line_id", "code", "valor"), _folder(spark, "reports")
    stores.write_reports(lines, f"{at}/json")
    stores.write_report_text(lines, f"{at}/text", ["line_id", "code", "valor"])
    text = spark.read.text(f"{at}/text").select(F.split("value", r" \| | \|$|^\| ").getItem(1).alias("line_id"), F.col("value").alias("text"))
    return spark.read.schema("line_id string, code string, valor long").json(f"{at}/json").join(text, "line_id").select("line_id", "code", "valor", "text")


@query("k02_packages", f"""WITH {DESCRIBED} SELECT account % 97 AS family, account, part, total + CASE WHEN account % 97 < 10 THEN 1 ELSE 0 END AS total FROM described WHERE account % 97 >= 10 OR total > 0""")
def k02(spark, sf):
    """Packages of account families; those of ten families are then written anew, the others stay as they are."""
    rows, at = star.described(spark, sf).select((F.col("account") % 97).alias("family"), "account", "part", "total"), _folder(spark, "packages")
    stores.write_packages(rows, at, "family")
    stores.write_packages(rows.filter("family < 10 and total > 0").withColumn("total", F.col("total") + 1), at, "family", only_touched=True)
    return spark.read.parquet(at).select(F.col("family").cast("long").alias("family"), "account", "part", "total")


@query("s06_package_folders", """SELECT c_mktsegment || ' ' || c_nationkey AS contract_id, 'R_' || c_custkey AS row_id, CAST(50 + c_nationkey AS DOUBLE) AS pct FROM customer""")
def s06(spark, sf):
    """One folder a contract with a package in each line, found by a glob and named by its folder."""
    c, at = star.table(spark, sf, "customer"), _folder(spark, "contracts")
    atom = F.array(F.struct((F.col("c_nationkey") + 50).cast("string").alias("value"), F.lit("%").alias("unit")))
    rows = c.select(F.concat_ws(" ", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("contract_id"),
                    F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("R_"), F.col("c_custkey").cast("string")).alias("row_id"), F.lit("COL_PREF_PCT").alias("column_id"), atom.alias("atoms"))).alias("assignments"))).alias("value"))
    rows.repartition("contract_id").write.partitionBy("contract_id").text(at)
    found = contracts.read_package_folders(spark, f"{at}/contract_id=*")
    rules = contracts.contract_rules(found)
    return rules.select("contract_id", F.concat(F.lit("R_"), "benefit").alias("row_id"), "pct")


@query("k04_stream_upsert", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def k04s(spark, sf):
    """Latest event of each user, by a stream that merges into shards of users."""
    at = _folder(spark, "latest")
    schema = star.table(spark, sf, "events").select("user_id", "ts", "event_id", "value").schema
    # A stream reads a folder or a glob.
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").withColumn("at", F.struct("ts", "event_id"))
    done = events.writeStream.foreachBatch(shards.merge_shards(f"{at}/table", "user_id", "at")).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{at}/table").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("a53_coverage_by_category", """WITH p AS (SELECT p_brand AS contract_id, p_partkey AS pos, CASE split_part(p_type, ' ', 1) WHEN 'SMALL' THEN '' WHEN 'PROMO' THEN NULL ELSE split_part(p_type, ' ', 1) END AS category, p_name AS item FROM part),
  c AS (SELECT *, CASE WHEN coalesce(category, '') = '' THEN 'SIN CATEGORÍA' ELSE category END AS shown FROM p), f AS (SELECT contract_id, shown, row_number() OVER (PARTITION BY contract_id ORDER BY foremost) AS category_no FROM (SELECT contract_id, shown, min(pos) AS foremost FROM c GROUP BY ALL))
  SELECT contract_id, shown AS category, category_no, row_number() OVER (PARTITION BY contract_id, shown ORDER BY pos) AS n, pos, '| ' || item || ' | - | - | - | - |  |' AS text FROM c JOIN f USING (contract_id, shown)""")
def a53(spark, sf):
    p = star.table(spark, sf, "part")
    kind = F.split("p_type", " ").getItem(0)
    rules = p.select(F.col("p_brand").alias("contract_id"), F.col("p_partkey").alias("pos"), F.when(kind == "SMALL", "").when(kind != "PROMO", kind).alias("category"), F.col("p_name").alias("item"))
    return C.coverage_by_category(rules).select("contract_id", "category", "category_no", "n", "pos", "text")
