"""Episodes and stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.catalog.base import CHARGES, DESCRIBED, LINES
from saldo.catalog.registry import query
from saldo.operators import episodes as E
from saldo.sources import star

KEY = "provider"
EPI = f"""{DESCRIBED}, st AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY provider ORDER BY ts) > INTERVAL 48 HOURS OR lag(ts) OVER (PARTITION BY provider ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT provider, ts FROM described)),
  ep AS (SELECT provider, ts, CAST(sum(s) OVER (PARTITION BY provider ORDER BY ts) AS BIGINT) AS episode FROM st), num AS (SELECT * FROM described JOIN ep USING (provider, ts))"""


def numbered(spark, sf):
    return E.episode_numbers(star.described(spark, sf), [KEY])


@query("w04_episode_numbers", f"WITH {EPI} SELECT provider, episode, count(*) AS lines, CAST(sum(total) AS BIGINT) AS amount FROM num GROUP BY ALL")
def w04(spark, sf):
    return E.episode_numbers(star.charges(spark, sf), [KEY]).groupBy("provider", "episode").agg(F.count("*").alias("lines"), F.sum("total").alias("amount"))


@query("a21_episodes", f"""WITH {EPI} SELECT provider, episode, min(ts) AS "start", max(ts) AS "end", count(*) AS lines, CAST(sum(copago) AS BIGINT) AS copago, CAST(sum(bonif) AS BIGINT) AS bonif,
  CASE WHEN bool_or(regexp_matches(code, '^(1[1-9]|20|21)') OR regexp_matches(description, 'PABELLON|ANESTESISTA|QUIRURGICO|CIRUJANO|ARSENALERA')) THEN 'QUIRURGICO' ELSE 'MEDICO' END AS kind, false AS team_complete FROM num GROUP BY provider, episode""")
def a21(spark, sf):
    return E.episodes(numbered(spark, sf), [KEY])


@query("p45_team_complete", f"""WITH {EPI}, r AS (SELECT *, description || CASE folio WHEN 'AF' THEN ' ANESTESISTA' WHEN 'NO' THEN ' ARSENALERA' ELSE '' END AS t FROM num) SELECT provider, episode, bool_or(contains(t, 'CIRUJANO')) AND bool_or(contains(t, 'ANESTESISTA')) AND bool_or(contains(t, 'ARSENALERA')) AS team_complete FROM r GROUP BY ALL""")
def p45(spark, sf):
    role = F.when(F.col("folio") == "AF", " ANESTESISTA").when(F.col("folio") == "NO", " ARSENALERA").otherwise("")
    return E.episodes(numbered(spark, sf).withColumn("description", F.concat("description", role)), [KEY]).select("provider", "episode", "team_complete")


@query("a19_consolidated_fees", f"""WITH {EPI} SELECT provider, episode, code, ts, CAST(sum(CAST(qty / 100 AS DECIMAL(18,4))) AS DOUBLE) AS qty, count(*) AS parts, CAST(sum(copago) AS BIGINT) AS copago, abs(sum(CAST(qty / 100 AS DECIMAL(18,4))) - 1) <= 0.15 AS valid_split
  FROM num WHERE regexp_matches(code, '^(1[1-8]|22)') OR regexp_matches(description, 'CIRUJANO|ANESTESISTA|ARSENALERA|AYUDANTE') GROUP BY ALL""")
def a19(spark, sf):
    return E.consolidated_fees(numbered(spark, sf).withColumn("qty", F.col("qty") / 100), [KEY])


STAYS = f"""{CHARGES}, sy AS (SELECT provider, account * 100 + part % 100 AS stay_id, ts AS s, ts + CAST(qty AS INT) * INTERVAL 1 HOUR AS e, folio LIKE 'R%' AS urgent FROM charges)"""


@query("j32_next_admission", f"""WITH {STAYS}, u AS (SELECT * FROM sy WHERE urgent), a AS (SELECT provider, s, min(stay_id) AS admission FROM sy WHERE NOT urgent GROUP BY ALL),
  n AS (SELECT u.provider, u.stay_id, u.e, min(a.s) AS nx FROM (SELECT DISTINCT provider, stay_id, e FROM u) u LEFT JOIN a ON a.provider = u.provider AND a.s >= u.e AND a.s <= u.e + INTERVAL 24 HOURS GROUP BY ALL)
  SELECT u.provider, u.stay_id, a.admission FROM u JOIN n USING (provider, stay_id, e) LEFT JOIN a ON a.provider = u.provider AND a.s = n.nx""")
def j32(spark, sf):
    c = star.charges(spark, sf)
    stays = c.select("provider", (F.col("account") * 100 + F.col("part") % 100).alias("stay_id"), F.col("ts").alias("start"),
                     F.expr("ts + make_dt_interval(0, cast(qty as int))").alias("end"), F.col("folio").startswith("R").alias("urgent"))
    return E.next_admission(stays, ["provider"])


@query("j32_duplicated_rights", f"""WITH {DESCRIBED}, g AS (SELECT account, bool_or(regexp_matches(description || ' ' || section, 'URGENCIA|EMERGENCIA')) AS u, count(*) FILTER (WHERE regexp_matches(code, '2001|2002|3101|3301') OR regexp_matches(description || ' ' || section, 'DERECHO.*URGENCIA|DERECHO.*SALA')) AS rights FROM described GROUP BY account) SELECT account, rights, u AND rights > 1 AS alert FROM g""")
def j32b(spark, sf):
    return E.duplicated_rights(star.described(spark, sf).withColumn("description", F.concat_ws(" ", "description", "section")), ["account"])


@query("s11_unit_value_by_day", f"""WITH {LINES}, v AS (SELECT CAST(ts AS DATE) AS day, avg(value) + 39000 AS value FROM (SELECT o_orderdate AS ts, CAST(o_orderkey % 1000 AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL)
  SELECT line_id, CAST(ts AS DATE) AS day, coalesce(value, 39750) AS unit_value FROM lines LEFT JOIN v ON day = CAST(ts AS DATE)""")
def s11(spark, sf):
    o = star.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    values = o.groupBy(F.to_date("o_orderdate").alias("day")).agg((F.avg((F.col("o_orderkey") % 1000).cast("double")) + 39000).alias("value"))
    return E.unit_value_by_day(star.settlement_lines(spark, sf), values).select("line_id", "day", "unit_value")
