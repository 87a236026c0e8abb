"""Contract pages: columns, rows, zones and cell assignments as intervals, and their quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.rules import first_match, search
from saldo.operators import ranges, sequence

# Texts that make an exception, a provider limit, or a merged id; density limits.
EXCEPTION = r"excepto|salvo|solo\s+en"
PROVIDER = r"Hosp\.|Clinica|Medicos"
MERGED_ID = r"C\d+_C\d+|C\d+\+C\d+"
MAX_ECHO = 5
MAX_SYNTHETIC = 0.3
ROW_HEIGHT = 0.02


def row_policy(row: Column, rules: list[tuple[str, str]], default: str = "ALLOW") -> Column:
    """Policy of the first pattern that matches the row id."""
    return first_match([(policy, row.rlike(pattern)) for pattern, policy in rules], default)


def orphan_assignments(assignments: DataFrame, rows: DataFrame) -> DataFrame:
    """Assignments that name a row the page does not have."""
    return assignments.join(rows.select("contract_id", "row_id").distinct(), ["contract_id", "row_id"], "left_anti")


def column_check(assignments: DataFrame, columns: DataFrame, width: float = 0.05, eps: float = 0.01) -> DataFrame:
    """Whether the middle of each box lies in its column, and the column it lies in."""
    a = assignments.withColumn("x_mid", (F.col("bx0") + F.col("bx1")) / 2)
    c = columns.select("contract_id", F.col("column_id").alias("_col"), "x0", "x1")
    hit = ranges.point_in_interval(a, c, ["contract_id"], "x_mid", "x0", "x1", width, eps)
    g = hit.groupBy("contract_id", "assignment_id").agg(F.bool_or(F.col("_col") == F.col("column_id")).alias("valid"), F.min_by("_col", F.struct("x0", "_col")).alias("found"))
    j = a.select("contract_id", "assignment_id", "column_id").join(g, ["contract_id", "assignment_id"], "left")
    ok = F.coalesce("valid", F.lit(False))
    return j.select("contract_id", "assignment_id", "column_id", ok.alias("valid"), F.when(~ok, F.col("found")).alias("correct_column"))


def covered_rows(rows: DataFrame, zones: DataFrame, width: float = 0.05) -> DataFrame:
    """Rows with whether a zone applies: a band zone of the page, or one that overlaps the row."""
    z = zones.filter("zone_type <> 'ZONE_EXCLUSION'")
    band = z.filter("scope_mode = 'ROW_BAND'").select("contract_id").distinct().withColumn("_band", F.lit(True))
    zr = z.filter("scope_mode <> 'ROW_BAND'").select("contract_id", F.col("y0").alias("z0"), F.col("y1").alias("z1")).distinct()
    hit = ranges.interval_overlap(rows.select("contract_id", "row_id", "y0", "y1"), zr, ["contract_id"], ("y0", "y1"), ("z0", "z1"), width)
    touched = hit.select("contract_id", "row_id").distinct().withColumn("_hit", F.lit(True))
    j = rows.join(touched, ["contract_id", "row_id"], "left").join(band, "contract_id", "left")
    return j.withColumn("has_zone", F.coalesce("_band", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_band", "_hit")


def coverage_metrics(rows: DataFrame, zones: DataFrame, policy: Column) -> DataFrame:
    """Rows that need a zone, those that have one, unexpected zones, the rate and the gate, per page."""
    r = covered_rows(rows, zones).withColumn("policy", policy)
    need, none = F.col("policy") == "REQUIRE", F.col("policy") == "NONE"
    g = r.groupBy("contract_id").agg(F.count_if(need).alias("expected"), F.count_if(need & F.col("has_zone")).alias("covered"), F.count_if(none & F.col("has_zone")).alias("unexpected"))
    rate = F.when(F.col("expected") > 0, F.col("covered") / F.col("expected")).otherwise(F.lit(1.0))
    gate = first_match([("FAIL", F.col("covered") < F.col("expected")), ("WARN", F.col("unexpected") > 0)], "PASS")
    return g.select("contract_id", "expected", "covered", "unexpected", rate.alias("rate"), gate.alias("gate"))


def missing_conditions(assignments: DataFrame, zones: DataFrame) -> DataFrame:
    """Assignments that point at an exception zone without a condition atom. ``atom_types`` is an array."""
    z = zones.filter(search(F.col("text"), EXCEPTION)).select("contract_id", F.col("zone_id").alias("target_id"))
    return assignments.join(z, ["contract_id", "target_id"]).filter(~F.array_contains("atom_types", "CONDITION")).select("contract_id", "assignment_id", "target_id")


def unflagged_zones(zones: DataFrame) -> DataFrame:
    """Zones whose text states an exception or a provider but which carry no condition flag."""
    t = F.col("text")
    return zones.filter((search(t, EXCEPTION) | search(t, PROVIDER)) & ~F.col("has_conditions"))


def lines_in_blocks(lines: DataFrame, blocks: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Contract lines with the blocks whose span holds them; a block without a last line runs to the end of its contract."""
    last = lines.groupBy(*keys).agg(F.max("line_no").alias("_last"))
    blocks = blocks.join(last, keys).withColumn("last_line", F.coalesce("last_line", "_last")).drop("_last").filter("first_line <= last_line")
    return ranges.point_in_interval(lines, blocks, keys, "line_no", "first_line", "last_line", width)


def scope_rows(scopes: DataFrame, rows: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Rows between the first and the last row of a scope, whichever comes first."""
    s = scopes.select(*keys, "scope_id", F.least("row_start", "row_end").alias("lo"), F.greatest("row_start", "row_end").alias("hi"))
    return ranges.point_in_interval(rows, s, keys, "row_no", "lo", "hi", width).select(*keys, "scope_id", "row_no")


def footnotes(marked: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """Footnote texts of the markers on rows, columns and scopes. ``markers`` is an array; restrictions are distinct rows."""
    # Distinct on both sides first: pairs of distinct rows are distinct, so the join makes no row that is thrown away.
    m = marked.select(*keys, "target_kind", "target_id", F.explode(F.array_distinct("markers")).alias("marker")).distinct()
    texts = notes.select(*keys, "marker", "text").distinct()
    return m.join(texts, [*keys, "marker"]).select(*keys, "target_kind", "target_id", "marker", "text")


def expand_spans(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid positions covered by cells with spans; where cells overlap the first one keeps the position."""
    one = F.lit(1)
    rows = F.sequence(F.col("row_index"), F.col("row_index") + F.greatest(F.coalesce("row_span", one), one) - 1)
    cols = F.sequence(F.col("col_index"), F.col("col_index") + F.greatest(F.coalesce("col_span", one), one) - 1)
    e = cells.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))
    g = e.groupBy(*keys, "r", "c").agg(F.min(F.struct("cell_no", "row_index", "col_index")).alias("b"))
    return g.select(*keys, "r", "c", F.col("b.cell_no").alias("cell_no"), ((F.col("r") != F.col("b.row_index")) | (F.col("c") != F.col("b.col_index"))).alias("carried"))


def promoted_zones(assignments: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Zones for header echoes: the row's and column's geometry, or a stacked band where the row has none."""
    a = assignments.filter("pointer_type = 'TEXT_ECHO_HEADER'").select("contract_id", "row_id", "column_id").distinct()
    j = a.join(columns.select("contract_id", "column_id", "x0", "x1"), ["contract_id", "column_id"], "left").join(
        rows.select("contract_id", "row_id", "y0", "y1"), ["contract_id", "row_id"], "left")
    bare = sequence.number(j.filter("y0 is null"), ["contract_id"], ["row_id", "column_id"], F.col("row_id"), name="n").select("contract_id", "row_id", "column_id", "n")
    k = j.join(bare, ["contract_id", "row_id", "column_id"], "left")
    y0 = F.coalesce("y0", F.lit(0.3) + (F.col("n") - 1) * ROW_HEIGHT)
    return k.select("contract_id", F.concat_ws("_", F.lit("ZONE_PROMOTED_HEADER"), "row_id", "column_id").alias("zone_id"), F.coalesce("x0", F.lit(0.4)).alias("x0"), F.coalesce("x1", F.lit(0.6)).alias("x1"),
                    F.round(y0, 6).alias("y0"), F.round(F.coalesce("y1", y0 + ROW_HEIGHT), 6).alias("y1"), F.col("y0").isNull().alias("synthetic"))


def assignment_gates(assignments: DataFrame, bad_rows: DataFrame, bad_columns: DataFrame, missing: DataFrame, zones: DataFrame) -> DataFrame:
    """Gates, counts and status of every page's assignments."""
    active = F.col("status").isin("ACTIVE", "ACTIVE_TEXT_DIRECT")
    n = F.count(F.lit(1))
    dup = assignments.groupBy("contract_id", "assignment_id").agg(n.alias("n")).groupBy("contract_id").agg(F.max("n").alias("dup"))
    cell = assignments.filter(active).groupBy("contract_id", "row_id", "column_id").agg(n.alias("n")).groupBy("contract_id").agg(F.max("n").alias("overlap"))
    of = lambda s: F.count_if(F.col("status") == s)
    g = assignments.groupBy("contract_id").agg(
        n.alias("assignments"), F.count_if(active).alias("active"), of("EXCLUDED").alias("excluded"), of("CONDITIONAL").alias("conditional"), of("UNDETERMINED").alias("undetermined"),
        F.avg(F.col("confidence").cast("decimal(18,4)")).cast("double").alias("confidence"), F.bool_or(F.col("assignment_id").rlike(MERGED_ID) | F.coalesce(F.col("column_id").rlike(MERGED_ID), F.lit(False))).alias("merged"),
        F.bool_or(active & (F.col("pointer_type") == "ZONE_REFERENCE") & ~F.array_contains("atom_types", "TEXT_DIRECT")).alias("weak"),
        F.bool_or(F.col("pointer_type") == "TEXT_ECHO_HEADER").alias("echo"))
    mark = lambda df, name: df.select("contract_id").distinct().withColumn(name, F.lit(True))
    syn = zones.groupBy("contract_id").agg(F.count_if("synthetic").alias("synthetic"))
    j = g.join(dup, "contract_id", "left").join(cell, "contract_id", "left").join(mark(bad_rows, "r"), "contract_id", "left").join(
        mark(bad_columns, "c"), "contract_id", "left").join(mark(missing, "m"), "contract_id", "left").join(syn, "contract_id", "left")
    bad = {"atomic_ids": F.col("merged"), "duplicate_ids": F.col("dup") > 1, "row_integrity": F.coalesce("r", F.lit(False)), "column_bbox": F.coalesce("c", F.lit(False)),
           "overlaps": F.coalesce(F.col("overlap") > 1, F.lit(False)), "conditions": F.coalesce("m", F.lit(False)), "terminal": F.col("weak"),
           "synthetic_density": F.coalesce(F.col("synthetic") / F.col("assignments") > MAX_SYNTHETIC, F.lit(False))}
    any_bad = F.lit(False)
    for b in bad.values():
        any_bad = any_bad | b
    status = F.when(any_bad | (F.col("undetermined") > 0), "NEEDS_REVIEW").otherwise("PASS")
    return j.select("contract_id", *[F.when(b, "FAIL").otherwise("PASS").alias(k) for k, b in bad.items()], "assignments", "active", "excluded", "conditional", "undetermined", "confidence", status.alias("status"))


def package_status(gates: DataFrame) -> DataFrame:
    """Status of a package: a failed gate or an undetermined cell needs review, then warnings, then conditions.

    gates: contract_id, gate, result, plus undetermined and conditional per contract.
    """
    g = gates.groupBy("contract_id").agg(F.bool_or(F.col("result") == "FAIL").alias("f"), F.bool_or(F.col("result") == "WARN").alias("w"), F.max("undetermined").alias("u"), F.max("conditional").alias("k"))
    return g.select("contract_id", first_match([("NEEDS_REVIEW", F.col("f") | (F.col("u") > 0)), ("WARN", (F.col("k") > 0) | F.col("w"))], "PASS").alias("status"))


def assemble_rules(cells: DataFrame) -> DataFrame:
    """Rule of each row from its cells: first percent, first event cap, annual cap; rows without a usable term go.

    cells: contract_id, row_id, pos, role (COVERAGE, EVENT, ANNUAL), text.
    """
    from saldo.functions.caps import financial_term
    from saldo.functions.money import number_tokens

    term = financial_term(F.col("text"))
    usable = term["state"].isin("NUMERIC", "SIN_TOPE")
    pick = lambda v, role, extra: F.min_by(v, F.when((F.col("role") == role) & extra, F.col("pos")))
    num = F.try_element_at(number_tokens(F.col("text")), F.lit(1))
    yes = F.lit(True)
    g = cells.groupBy("contract_id", "row_id").agg(pick(num, "COVERAGE", yes).alias("pct"), pick(term, "EVENT", yes).alias("_e"), pick(term, "ANNUAL", yes).alias("_a"))
    ok = lambda s: F.col(f"{s}.state").isin("NUMERIC", "SIN_TOPE")
    e, a = F.when(ok("_e"), F.col("_e")), F.when(ok("_a"), F.col("_a"))
    r = g.select("contract_id", "row_id", "pct", e["state"].alias("event_state"), e["amount"].alias("event_cap"), a["state"].alias("annual_state"), a["amount"].alias("annual_cap"))
    return r.filter("pct is not null or event_state is not null or annual_state is not null")


def contract_reconstructibility(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Share of rows with a rule, and whether the contract can be verified."""
    has = rules.select("contract_id", "row_id").distinct().withColumn("_r", F.lit(True))
    g = rows.join(has, ["contract_id", "row_id"], "left").groupBy("contract_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_r")).alias("resolved"))
    score = F.round(F.col("resolved") / F.col("rows"), 2)
    return g.select("contract_id", "rows", "resolved", score.alias("score"), first_match([("VERIFIABLE", score >= 0.85), ("PARCIAL", score >= 0.45)], "NO_VERIFICABLE").alias("status"))


def resolve_paths(references: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct providers behind each benefit's path ids. ``path_ids`` and ``providers`` are arrays."""
    r = references.select("benefit_id", F.explode(F.array_distinct("path_ids")).alias("path_id")).distinct()
    p = paths.select("path_id", "pct", F.explode("providers").alias("provider")).distinct()
    return r.join(p, "path_id").select("benefit_id", "pct", "provider").distinct()


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Depth and root of every node of a forest given as (id, parent), of any depth.

    Every node points at its parent and each round doubles how far up it points, so rounds grow with the logarithm of the
    depth. Nodes that reach no root (a missing parent, a cycle) are not in the result.
    """
    from saldo.session import checkpoint

    roots = checkpoint(nodes.filter("parent is null").select("id"))
    out = roots.select("id", F.col("id").alias("root"), F.lit(0).alias("depth"))
    top = roots.select(F.col("id").alias("up"))
    done = None
    rest = checkpoint(nodes.filter("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).alias("depth")))
    while True:
        new = checkpoint(rest.join(top.distinct(), "up", "left_semi"))
        if new.isEmpty():
            break
        open_ = rest.join(top.distinct(), "up", "left_anti")
        done = new if done is None else done.unionByName(new)
        jump = done.unionByName(open_).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        rest = checkpoint(open_.join(jump, "up").select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth")))
    if done is None:
        return out
    return out.unionByName(done.join(top, "up").select("id", F.col("up").alias("root"), "depth"))
