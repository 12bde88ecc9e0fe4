"""Item tables from lines: column assignment, cells to rows, fill statistics, profiles and columns to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.rects import dividers, finite
from lineweave.functions.text import cell, meaningless, to_int

#: Keys of a canonical table row and the order in which columns are shown.
CANONICAL = ("itemCode", "itemName", "spec", "lotNo", "serialNo", "manufacturingNo", "expiryDate", "quantity", "unit", "unitPrice", "supplyAmount", "taxAmount", "amount", "totalAmount", "manufacturer", "insuranceCode", "remark")

#: Columns of a template at most; it is broadcast.
TEMPLATE_ROWS = 1_000


def boundaries(headers: DataFrame) -> DataFrame:
    """Column intervals from header cells (doc_id, key, x, w): edges at the midpoints between neighbours."""
    order = Window.partitionBy("doc_id").orderBy("x", "key")
    left, right = F.col("x"), F.col("x") + F.col("w")
    start = (F.lag(right).over(order) + left) / 2
    end = (right + F.lead(left).over(order)) / 2
    return headers.select("doc_id", "key", F.coalesce(start, F.lit(0.0)).alias("x_start"), F.coalesce(end, F.lit(1e9)).alias("x_end"), (left + F.col("w") / 2).alias("header_cx"))


def expected_boundaries(expected: DataFrame, matched: DataFrame, tables: DataFrame, *, allow_single: bool = False) -> DataFrame:
    """Column intervals of tables whose headers are only partly found: required columns between them are filled in.

    ``expected``: doc_id, key, place (from 0), required; ``matched``: doc_id, key, x, w, cx of the header found; ``tables``: doc_id,
    x_min, x_max. A required column without a header lies in proportion between the headers found before and behind it,
    or by the mean width next to the one on its side; an optional one is left out. Two headers are needed, or one of
    three required columns with ``allow_single``.

    Returns doc_id, key, x_start, x_end, header_cx, source (expected_header, interpolated_expected), display_only.
    """
    doc, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("place")
    m = matched.select("doc_id", "key", F.col("x").alias("x_left"), F.col("cx").alias("m_cx"), (F.col("x") + F.col("w")).alias("x_right"))
    c = expected.join(m, ["doc_id", "key"], "left").join(tables.select("doc_id", "x_min", "x_max"), "doc_id")
    found = F.col("m_cx").isNotNull()
    c = c.withColumn("n_found", F.count("m_cx").over(doc)).withColumn("n_required", F.sum(F.col("required").cast("int")).over(doc))
    c = c.withColumn("n_used", F.col("n_found") + F.sum((F.col("required") & ~found).cast("int")).over(doc))
    enough = F.when(F.lit(allow_single) & (F.col("n_required") >= 3), 1).otherwise(2)
    c = c.where(F.col("n_found") >= enough)
    here = F.when(found, F.struct("place", "x_left", F.col("m_cx").alias("cx"), "x_right"))
    c = c.withColumn("before", F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("behind", F.first(here, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    c = c.where(found | F.col("required"))
    half = (F.col("x_max") - F.col("x_min")) / F.greatest("n_used", F.lit(1)) * 0.4
    first_span = (F.col("behind.x_right") - F.col("x_min")) / F.greatest("n_used", F.lit(1))
    last_span = (F.col("x_max") - F.col("before.x_left")) / F.greatest(F.col("n_used") - F.col("before.place"), F.lit(1))
    share = (F.col("place") - F.col("before.place")) / F.greatest(F.col("behind.place") - F.col("before.place"), F.lit(1))
    guess = F.when(F.col("before").isNull(), F.greatest(F.col("x_min") + first_span * 0.5, F.col("behind.cx") - first_span * (F.col("behind.place") - F.col("place") + 1)))
    guess = guess.when(F.col("behind").isNull(), F.least(F.col("x_max") - last_span * 0.5, F.col("before.cx") + last_span * (F.col("place") - F.col("before.place"))))
    guess = guess.otherwise(F.col("before.cx") + share * (F.col("behind.cx") - F.col("before.cx")))
    c = c.withColumn("header_cx", F.coalesce("m_cx", guess)).withColumn("source", F.when(found, "expected_header").otherwise("interpolated_expected"))
    c = c.withColumn("left", F.coalesce("x_left", F.col("header_cx") - half)).withColumn("right", F.coalesce("x_right", F.col("header_cx") + half)).where(F.col("header_cx").isNotNull())

    def edge(right: Column, left: Column, cx: Column, next_cx: Column, past: Column) -> Column:
        return F.when(past, (cx + next_cx) / 2).otherwise((right + left) / 2)

    prev_cx, next_cx = F.lag("header_cx").over(order), F.lead("header_cx").over(order)
    prev_right, next_left = F.lag("right").over(order), F.lead("left").over(order)
    start = edge(prev_right, F.col("left"), prev_cx, F.col("header_cx"), (prev_right + F.col("left")) / 2 <= prev_cx)
    end = edge(F.col("right"), next_left, F.col("header_cx"), next_cx, (F.col("right") + next_left) / 2 >= next_cx)
    c = c.withColumn("x_start", F.coalesce(start, "x_min")).withColumn("x_end", F.coalesce(end, "x_max")).withColumn("n", F.count(F.lit(1)).over(doc)).where("n >= 2")
    return c.select("doc_id", "key", "x_start", "x_end", "header_cx", "source", (F.col("key") == "rowIndex").alias("display_only"))


def guide_boundaries(tables: DataFrame) -> DataFrame:
    """Column intervals from a template's dividers: doc_id, key, x_start, x_end, header_cx, display_only, mismatch.

    ``tables``: doc_id, x_min, x_max, guides (places on the page), keys (required columns in order). ``mismatch`` tells guides
    too_many or fewer (found against needed) and no_guides_even_split; null where they fit.
    """
    n = F.size("keys")
    found = F.size(F.filter(F.coalesce("guides", F.array().cast("array<double>")), lambda g: finite(g) & g.between(F.col("x_min"), F.col("x_max"))))
    counts = F.concat(found.cast("string"), F.lit("vs"), (n - 1).cast("string"))
    mismatch = F.when(found == n - 1, None).when(found >= n, F.concat(F.lit("too_many:"), counts)).when(found > 0, F.concat(F.lit("fewer:"), counts)).otherwise("no_guides_even_split")
    t = tables.where(n > 0).withColumn("mismatch", mismatch).withColumn("edges", F.when((n == 1) & (found == 0), F.array("x_min", "x_max")).otherwise(dividers(F.col("x_min"), F.col("x_max"), F.col("guides"), n)))
    t = t.select("doc_id", "edges", "mismatch", F.posexplode("keys").alias("i", "key"))
    start, end = F.get(F.col("edges"), F.col("i")), F.get(F.col("edges"), F.col("i") + 1)
    return t.select("doc_id", "key", start.alias("x_start"), end.alias("x_end"), ((start + end) / 2).alias("header_cx"), (F.col("key") == "rowIndex").alias("display_only"), "mismatch")


def assign_columns(lines: DataFrame, bounds: DataFrame, reach: float = 0.7) -> DataFrame:
    """Adds ``key``: the column whose interval holds cx, else the nearest header within ``reach`` average widths.

    ``bounds`` (key, x_start, x_end, header_cx) is one template and is broadcast, so one of more than ``TEMPLATE_ROWS`` rows
    is refused (its rows are counted at once); with a ``doc_id`` it is one per document and joined by it. Lines that
    reach no column are dropped.
    """
    by_doc = "doc_id" in bounds.columns
    if not by_doc and bounds.limit(TEMPLATE_ROWS + 1).count() > TEMPLATE_ROWS:
        raise ValueError(f"a template has at most {TEMPLATE_ROWS} columns; give bounds a doc_id to join them by document")
    whole = Window.partitionBy("b_doc") if by_doc else Window.partitionBy()
    own = bounds.withColumnRenamed("doc_id", "b_doc").withColumn("avg_w", F.avg(F.col("x_end") - F.col("x_start")).over(whole))
    far = lambda b: F.abs(F.col("cx") - b["header_cx"])
    inside = lambda b: (F.col("cx") >= b["x_start"]) & (F.col("cx") < b["x_end"])
    on = lambda b: inside(b) | (far(b) <= reach * b["avg_w"])
    rank = lambda b: (F.when(inside(b), 0).otherwise(1).alias("out"), far(b).alias("far"), b["key"].alias("key"))
    if not by_doc:
        # a line is looked up in the whole template, so lines are neither multiplied nor sorted
        template = F.broadcast(own.agg(F.collect_list(F.struct("key", "x_start", "x_end", "header_cx", "avg_w")).alias("template")))
        hit = lines.crossJoin(template).withColumn("key", F.array_min(F.transform(F.filter("template", on), lambda b: F.struct(*rank(b))))["key"])
        return hit.where("key is not null").select(*lines.columns, "key")
    at = {c: F.col(c) for c in own.columns}
    best = Window.partitionBy("doc_id", "line_idx").orderBy(*rank(at))
    hit = lines.join(own, on(at) & (F.col("doc_id") == F.col("b_doc")))
    return hit.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*lines.columns, "key")


def cells_to_rows(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each (doc_id, row_idx), a text column for each key, cells of one column joined from left to right."""
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("key") == k, F.struct("x", "text")))), lambda p: p["text"]), " ")
    return cells.groupBy("doc_id", "row_idx").agg(*(cell(joined(k)).alias(k) for k in keys))


def fill_by_column(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(doc_id, key, filled, n_rows, fill_rate): cells that mean something, in percent to one decimal."""
    long = rows.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("v")) for k in keys))).alias("c")).select("doc_id", "c.key", "c.v")
    filled = F.sum((~meaningless(F.col("v"))).cast("long"))
    n = F.count(F.lit(1))
    return long.groupBy("doc_id", "key").agg(filled.alias("filled"), n.alias("n_rows"), F.bround(filled * 100.0 / n, 1).alias("fill_rate"))


def missing_keys(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(doc_id, key) of expected columns without any filled cell."""
    return fill_by_column(rows, keys).where("filled = 0").select("doc_id", "key")


def table_profile(rows: DataFrame) -> DataFrame:
    """(doc_id, n_rows, profile) from which kinds of columns are filled."""
    has = lambda k: F.bool_or(~meaningless(F.col(k))) if k in rows.columns else F.lit(False)
    lot, serial, amount, code = has("lotNo"), has("serialNo"), has("amount"), has("itemCode")
    n = F.count(F.lit(1))
    profile = F.when(lot & serial, "lot_serial").when(lot, "lot").when(amount & code, "code_amount").when(amount, "amount").when(n > 0, "plain").otherwise("empty")
    return rows.groupBy("doc_id").agg(n.alias("n_rows"), profile.alias("profile"))


def display_columns(rows: DataFrame, keys: tuple[str, ...], least_code_ratio: float = 0.05) -> DataFrame:
    """(doc_id, columns): filled columns in canonical order; item codes only over ``least_code_ratio`` of the rows."""
    share = lambda k: F.avg((~meaningless(F.col(k))).cast("double"))
    order = [k for k in CANONICAL if k in keys]
    shown = [F.when(share(k) > (least_code_ratio if k == "itemCode" else 0.0), k) for k in order]
    return rows.groupBy("doc_id").agg(F.array_join(F.array_compact(F.array(*shown)), ",").alias("columns"))


def column_score(row: dict[str, Column] | None = None, keys: tuple[str, ...] = CANONICAL) -> Column:
    """Number of filled cells in a row."""
    return sum(((~meaningless(F.col(k))).cast("int") for k in keys), F.lit(0))


def reconciled(rows: DataFrame) -> DataFrame:
    """Adds ``amount_num`` and ``quantity_num``, typed shadows of the text cells."""
    return rows.withColumn("amount_num", to_int(F.col("amount"))).withColumn("quantity_num", to_int(F.col("quantity")))
