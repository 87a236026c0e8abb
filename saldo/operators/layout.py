"""Ordered contract lines and printed cells: values that carry down, blocks, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.rules import first_match, search
from saldo.operators import sequence

def sticky_percent(lines: DataFrame, keys: list[str], default: int = 90) -> DataFrame:
    """Percent of each line: its own, else the last explicit one, else the default. A section title ends the carrying after itself."""
    own = F.regexp_extract("text", r"(\d{1,3})\s*%", 1).try_cast("int")
    edge = search(F.col("text"), "HOSPITALARIA|AMBULATORIA|URGENCIA")
    state = F.when(edge, -1).otherwise(own)
    c = sequence.carry(lines, keys, ["line_no"], sequence.by_pos("line_no"), priors={"_p": state})
    kept = F.when(F.col("_p") >= 0, F.col("_p"))
    return c.withColumn("pct", F.coalesce(own, kept, F.lit(default))).drop("_p")


def column_context(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Percent last seen in the column of a cell, the cell included."""
    pct = F.regexp_extract("text", r"(\d+)%", 1).try_cast("int")
    return sequence.carry(cells, [*keys, "col"], ["line_no"], sequence.by_pos("line_no"), lasts={"column_pct": pct})


# Headers that end a block.
MAJOR_HEADERS = "TOPES DE BONIFICACION|VALORIZACION TOPES|PRESTACIONES DENTALES|NOTAS EXPLICATIVAS"


def propagate_blocks(cells: DataFrame, lines: DataFrame, keys: list[str], split: int = 5) -> DataFrame:
    """Percent block in force at each benefit line, per modality. Exclusions and major headers end a block.

    cells: keys, line_no, col, text; lines: keys, line_no, text, benefit (boolean).
    """
    pct = F.regexp_extract("text", r"(\d{1,3})\s*%", 1).try_cast("int")
    cut = search(F.col("text"), "solo.*libre\\s+elecc")
    modality = F.when(F.col("col") < split, "preferente").otherwise("libre_eleccion")
    marks = cells.select(*keys, "line_no", "col", modality.alias("modality"), F.when(cut, -1).otherwise(pct).alias("m")).filter("m is not null")
    last = marks.groupBy(*keys, "modality", "line_no").agg(F.max_by("m", "col").alias("mark"))
    both = lines.withColumn("modality", F.explode(F.array(F.lit("preferente"), F.lit("libre_eleccion"))))
    j = both.join(last, [*keys, "modality", "line_no"], "left")
    state = F.when(search(F.col("text"), MAJOR_HEADERS), -1).otherwise(F.col("mark"))
    c = sequence.carry(j, [*keys, "modality"], ["line_no"], sequence.by_pos("line_no"), lasts={"pct": state})
    return c.filter("benefit and pct >= 0").select(*keys, "line_no", "modality", "pct")


def cut_inheritance(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines locked to free choice: from a lock text down to the next preferred-offer header."""
    from saldo.operators.classify import is_modality_lock

    t = F.col("text")
    state = F.when(search(t, "OFERTA PREFERENTE"), 0).when(is_modality_lock(t), 1)
    c = sequence.carry(lines, keys, ["line_no"], sequence.by_pos("line_no"), lasts={"_s": state})
    return c.withColumn("locked", F.coalesce("_s", F.lit(0)) == 1).drop("_s")


def annual_blocks(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Span of each annual cap point. marks: keys, line_no, value, is_point, is_stop; one row per line.

    The first point of a section reaches up to its start, the next ones follow the previous point, all end before
    the next point or at the next section. ``last_line`` is null where neither follows: the block runs to the end.
    """
    point, stop = F.when(F.col("is_point"), F.col("line_no")), F.when(F.col("is_stop"), F.col("line_no"))
    c = sequence.carry(marks, keys, ["line_no"], sequence.by_pos("line_no"), lasts={"_start": stop}, follows={"_end": stop, "_next": point}, priors={"_prev": point})
    start = F.coalesce("_start", F.lit(0))
    first = F.col("_prev").isNull() | (F.col("_prev") < start)
    return c.filter("is_point").select(*keys, "line_no", "value", F.when(first, start).otherwise(F.col("_prev") + 1).alias("first_line"),
                                       F.least(F.col("_end"), F.col("_next") - 1).alias("last_line"))


def row_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Vertical bands between section header rows."""
    heads = rows.filter(search(F.col("raw_text"), "hospitalaria|ambulatoria"))
    c = sequence.carry(heads, keys, ["y0", "row_id"], F.floor(F.col("y0") * 16), after={"_next": F.col("y0")})
    return c.select(*keys, F.concat(F.lit("G_"), F.col("row_id").cast("string")).alias("group_id"), F.col("y1").alias("y_start"), F.coalesce("_next", F.lit(1.0)).alias("y_end"))


def cluster_rows(cells: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Row number of each cell: heights closer than the tolerance to the one above form a row.

    Rows are chains of near heights. Works on the distinct heights of a page.
    """
    heights = cells.select(*keys, (-F.col("y")).alias("_y")).distinct()
    n = sequence.islands(heights, keys, "_y", F.lit(tolerance), name="row_no", chunk=F.floor(F.col("_y") / 256))
    return cells.withColumn("_y", -F.col("y")).join(n, [*keys, "_y"]).drop("_y")


def row_texts(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each printed row, cells from left to right."""
    cells = F.transform(F.sort_array(F.collect_list(F.struct("x", "text"))), lambda c: c["text"])
    return clustered.groupBy(*keys, "row_no").agg(F.count(F.lit(1)).alias("cells"), F.array_join(cells, " ").alias("text"))


def stitch_orphans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Amount-only rows and the label row they belong to: the nearest of the two rows above that has a label and no amount.

    A label takes the first orphan that chooses it.
    """
    label = F.length(F.regexp_replace("text", r"[\d.,$%\s/-]", ""))
    finance = F.col("text").rlike(r"\d") & F.upper("text").rlike(r"VA|\$|UF|\d{3}")
    r = rows.withColumns({"orphan": finance & (label < 4), "anchor": (label > 10) & ~finance})
    here = F.when(F.col("anchor"), F.col("row_no"))
    one = sequence.carry(r, keys, ["row_no"], sequence.by_pos("row_no"), before={"_up1": here})
    two = sequence.carry(one, keys, ["row_no"], sequence.by_pos("row_no"), before={"_up2": F.col("_up1")})
    chosen = two.filter("orphan").select(*keys, "row_no", F.coalesce("_up1", "_up2").alias("label_row")).filter("label_row is not null")
    return chosen.groupBy(*keys, "label_row").agg(F.min("row_no").alias("orphan_row"))


def resection(items: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Items under the header printed above them (heights fall down the page); items above the first header have none."""
    h = headers.select(*keys, (-F.col("y")).alias("_y"), F.lit(0).alias("_k"), F.col("section").alias("_head"), F.lit(None).cast("string").alias("item_id"))
    i = items.select(*keys, (-F.col("y")).alias("_y"), F.lit(1).alias("_k"), F.lit(None).cast("string").alias("_head"), F.col("item_id").cast("string").alias("item_id"))
    c = sequence.carry(h.unionByName(i), keys, ["_y", "_k", "item_id"], F.floor(F.col("_y") / 256), lasts={"section": F.col("_head")})
    return c.filter("_k = 1 and section is not null").select(*keys, "item_id", "section")


def strict_ids(assignments: DataFrame, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Ids a_<row>_<column>, with _2, _3 ... for repeats."""
    n = sequence.number(assignments, [*keys, "row_id", "column_id"], order, chunk, name="_n")
    base = F.concat_ws("_", F.lit("a"), "row_id", "column_id")
    return n.withColumn("assignment_id", F.when(F.col("_n") == 1, base).otherwise(F.concat_ws("_", base, F.col("_n").cast("string")))).drop("_n")


def implicit_scopes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of two or more consecutive non-blank cells of a column with some text form one scope."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    c = sequence.carry(cells, [*keys, "col"], ["row_no"], sequence.by_pos("row_no"), sums={"_seg": F.when(blank, 1).otherwise(0).cast("long")})
    g = c.filter(~blank).groupBy(*keys, "col", "_seg").agg(F.count(F.lit(1)).alias("cells"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
                                                           F.bool_or(~F.col("text").rlike(r"^[\d.,%\s]+$")).alias("worded"))
    return g.filter("cells >= 2 and worded").select(*keys, "col", "first_row", "last_row", "cells")


def nearest_entry(rows: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entry of each row: its own, else the nearer of the previous and the next one; at equal distance the previous."""
    j = rows.join(entries.select(*keys, "row_no", F.lit(True).alias("_has")), [*keys, "row_no"], "left")
    at = F.when(F.col("_has"), F.col("row_no"))
    c = sequence.carry(j, keys, ["row_no"], sequence.by_pos("row_no"), lasts={"_p": at}, nexts={"_n": at})
    near = F.when(F.col("_p").isNull(), F.col("_n")).when(F.col("_n").isNull(), F.col("_p")).when(F.col("row_no") * 2 <= F.col("_p") + F.col("_n"), F.col("_p")).otherwise(F.col("_n"))
    return c.select(*keys, "row_no", near.alias("entry_row"), (near != F.col("row_no")).alias("propagated")).filter("entry_row is not null")
