"""The star tables as bills and settlements, in the SQL of the checks."""

from __future__ import annotations

from saldo.sources import star


def case(col: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {whens} END"


CHARGES = """charges AS (
  SELECT l_orderkey AS account, l_linenumber AS page, l_partkey AS part, l_suppkey AS provider, l_quantity AS qty, total,
         CASE WHEN l_returnflag = 'R' THEN total ELSE total * CAST(round(l_discount * 100) AS BIGINT) // 100 END AS copago,
         l_returnflag || l_linestatus AS folio, l_shipdate AS ts,
         total - CASE WHEN l_returnflag = 'R' THEN total ELSE total * CAST(round(l_discount * 100) AS BIGINT) // 100 END AS bonif
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS total FROM lineitem))"""

PARTS = f"""parts AS (
  SELECT p_partkey AS part, {case("split_part(p_name, ' ', 2)", star.GLOSS)} || ' ' || {case("split_part(p_name, ' ', 1)", star.QUALIFIER)} AS description,
         {case("p_type", star.SECTION)} AS section,
         lpad(regexp_extract(p_brand, '#(\\d+)', 1), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0') || '001' AS code,
         CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price, p_size AS size, p_type, p_name FROM part)"""

DESCRIBED = f"{CHARGES}, {PARTS}, described AS (SELECT * FROM charges JOIN parts USING (part))"

ITEMS = f"""{DESCRIBED}, items AS (
  SELECT *, 'B_' || lpad(CAST(pos AS VARCHAR), 5, '0') AS item_id FROM (
    SELECT *, row_number() OVER (PARTITION BY account ORDER BY page, part, provider, total, qty, folio, ts) AS pos FROM described))"""

NUMBERED = f"""{CHARGES}, items AS (
  SELECT *, row_number() OVER (PARTITION BY account ORDER BY page, part, provider, total, qty, folio, ts) AS pos FROM charges)"""

LINES_ONLY = f"""lines AS (
  SELECT account, folio, CAST(sum(total) AS BIGINT) AS valor, CAST(sum(bonif) AS BIGINT) AS bonif, CAST(sum(copago) AS BIGINT) AS copago,
         count(*) AS items, min(provider) AS provider, min(ts) AS ts, CAST(account AS VARCHAR) || ':' || folio AS line_id,
         {case("folio", star.LINE_CODE)} AS code, {case("folio", star.LINE_TEXT)} AS description
  FROM charges GROUP BY account, folio)"""

LINES = f"{CHARGES}, {LINES_ONLY}"

ACCOUNTS = """accounts AS (
  SELECT o_orderkey AS account, r_name AS contract_id, CAST(round(o_totalprice * 100) AS BIGINT) AS stated_total, o_orderdate AS ts,
         o_orderpriority AS priority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_DOM = "[" + ", ".join(f"'{d}'" for d in star.DOMAINS[:-1]) + "]"
_KIND = "[" + ", ".join(f"'{d}'" for d in star.CAP_KINDS) + "]"
RULES = f"""rules AS (
  SELECT contract_id, 'R' || CAST(pos AS VARCHAR) AS rule_id, pos, domain,
         CASE WHEN pos % 2 = 0 THEN 'preferente' ELSE 'libre_eleccion' END AS modality,
         CAST(CASE WHEN pos % 11 = 0 THEN NULL ELSE 50 + (pos * 7) % 51 END AS DOUBLE) AS pct,
         {_KIND}[1 + CAST(pos % 5 AS INT)] AS cap_kind,
         CAST(CASE WHEN pos % 5 = 1 THEN NULL ELSE pos % 90 + 1 END AS DOUBLE) AS cap_value, clinic,
         domain || ' ' || CASE WHEN pos % 2 = 0 THEN 'preferente' ELSE 'libre_eleccion' END || ' ' || clinic AS text
  FROM (SELECT r_name AS contract_id, n_name AS clinic, CAST(n_nationkey AS BIGINT) * 10 + d AS pos, {_DOM}[1 + CAST(d AS INT)] AS domain
        FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest(range(0, 6)) AS d)))"""

STRICT = "trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9 ]', '', 'g'))"
UPPER = "trim(regexp_replace(strip_accents(upper({c})), '\\s+', ' ', 'g'))"


def strict(c: str) -> str:
    return STRICT.format(c=c)


def upper(c: str) -> str:
    return UPPER.format(c=c)


def any_like(c: str, words: list[str]) -> str:
    """Contains any of the words, as a chain of contains()."""
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def rx(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '(?i){pattern}')"

_DOT = "replace(format('{{:,}}', {c}), ',', '.')"
ROWS = f"""{DESCRIBED}, {LINES_ONLY}, rws AS (
  SELECT account, page, part * 1000 + provider AS row_no, CASE WHEN folio LIKE 'N%' THEN 'item_secondary' ELSE 'item_primary' END AS kind,
         description || ' ' || CAST(qty AS INT) || ' ' || {_DOT.format(c='total')} || ' ' || {_DOT.format(c='copago')} AS text FROM described
  UNION ALL SELECT account, 8, provider, 'footer', 'TOTAL EMPRESA ' || {_DOT.format(c='valor')} || ' ' || {_DOT.format(c='bonif')} FROM lines WHERE folio LIKE '%F')"""

TOKENS = ("list_filter(list_transform(regexp_extract_all({c}, '\\d{{1,3}}(?:\\.\\d{{3}})+(?:,\\d+)?|\\d+(?:,\\d+)?'), "
          "lambda x: CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE)), lambda x: x > 0)")


def tokens(c: str) -> str:
    return TOKENS.format(c=c)


def largest(c: str) -> str:
    return f"CAST(coalesce(floor(list_max({tokens(c)}) + 0.5), 0) AS BIGINT)"


def charge(c: str) -> str:
    t = tokens(c)
    return f"CASE WHEN len({t}) < 2 THEN 0 ELSE CAST(floor(greatest(({t})[-1], ({t})[-2]) + 0.5) AS BIGINT) END"
