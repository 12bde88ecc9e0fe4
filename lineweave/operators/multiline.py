"""Tables read column by column: all names, then all codes, then all prices. Their blocks go back to the rows in the order of names.

The reading order of a page is a window; blocks are runs of lines of one kind in it, found by windows of the same order. Only the names, as
many as a table has rows, are folded over the page's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import tokens as K
from lineweave.functions.text import fix_digits

#: Item codes, amounts, labels with the most letters of a line that is one, and words that end a block of quantities.
ITEM_CODE, AMOUNT = r"^[A-Z][A-Z0-9]{4,9}$", r"^\d{1,3}(?:,\d{3})+$"
PRICE_LABEL, AMOUNT_LABEL, LABEL_LETTERS = "단가", "금액", 6
QUANTITY_LABELS, QUANTITY_LABEL_LETTERS = ("수량", "Qty", "QTY"), 8
QUANTITY_END = r"(?i)단\s*가|금\s*액|공\s*급|세\s*액|합\s*계|부\s*가|\bVAT\b|\bTAX\b"
#: Fixed value: lines behind a label that are looked at, for each row.
LINES_A_ROW = 8
KEYS = ("itemCode", "quantity", "unitPrice", "amount")


def reading_order(lines: DataFrame) -> DataFrame:
    """doc_id, place (from 0), text: cleaned lines down the page, then across."""
    order = Window.partitionBy("doc_id").orderBy("cy", "x", "line_idx")
    return lines.select("doc_id", (F.row_number().over(order) - 1).alias("place"), K.clean_value(F.col("text")).alias("text"))


def _fits(t: Column, n: Column) -> Column:
    return (n != "") & ((t == n) | (F.length(t) >= 6) & F.contains(n, t) | (F.length(n) >= 6) & F.contains(t, n))


def _names(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["row_idx"].alias("row_idx"), F.trim(K.text_of(r["itemName"])).alias("name")))


def _near(text: Column, names: Column) -> Column:
    """Only lines that fit some name can take one."""
    return (F.length(text) >= 3) & F.exists(names, lambda r: _fits(text, r["name"]))


def _order(texts: Column, names: Column) -> Column:
    """The rows in the order in which lines take their names; null where not all are taken."""

    def taken(state: Column, line: Column) -> Column:
        left = F.filter(names, lambda r: ~F.array_contains(state, r["row_idx"]) & _fits(line["text"], r["name"]))
        return F.when(F.size(left) > 0, F.concat(state, F.array(F.get(left, F.lit(0))["row_idx"]))).otherwise(state)

    order = F.aggregate(texts, F.array().cast("array<int>"), taken)
    return F.when(F.size(order) == F.size(names), order)


def name_order(ordered: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, row_idx, seq: the place of each row's name among the names as they are read, on pages where all are found.

    A line of three letters or more takes the first row left whose name is the line, holds it, or is held by it, the held one of
    six letters at least. ``rows``: doc_id, row_idx, itemName.
    """
    names = rows.groupBy("doc_id").agg(_names(F.sort_array(F.collect_list(F.struct("row_idx", "itemName")))).alias("names"))
    near = ordered.join(names, "doc_id").where(_near(F.col("text"), F.col("names")))
    pages = near.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("texts"), F.first("names").alias("names"))
    found = pages.select("doc_id", _order(F.col("texts"), F.col("names")).alias("order"))
    return found.select("doc_id", F.posexplode("order").alias("seq", "row_idx"))


def _blocks(page: DataFrame, keys: tuple[str, ...], label: dict[str, str], digits: dict[str, int], order: tuple[str, ...], *more: Column) -> DataFrame:
    """doc_id and, for each of ``keys``, an array of the first ``n`` values (null: none), and ``more`` aggregates. ``page``: doc_id, place, text, n, ``order``.

    Windows and one aggregation by document, in the order of ``order``, so lines that are dealt out by document stay where they are.
    ``label``: what prices and amounts stand behind, by key; ``digits``: their least digits.
    """
    whole = Window.partitionBy("doc_id")
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place, n, text = F.col("place"), F.col("n"), F.col("text")
    held: list[Column] = [F.first("n").alias("n"), *more]
    values: dict[str, Column] = {}
    among = lambda when, value: F.array_sort(F.collect_list(F.when(when, F.struct("place", value.alias("value")))))
    if "itemCode" in keys:
        # a run is long enough where its line of that number is reached; the first such run gives the codes
        page = page.withColumn("code", text.rlike(ITEM_CODE) & text.rlike(r"\d"))
        page = page.withColumn("seq", place - F.coalesce(F.max(F.when(~F.col("code"), place)).over(running), F.lit(-1)))
        page = page.withColumn("end", F.min(F.when(F.col("code") & (F.col("seq") == n), place)).over(whole))
        held.append(among((place > F.col("end") - n) & (place <= F.col("end")), text).alias("codes"))
        values["itemCode"] = F.col("codes")
    if "quantity" in keys:
        is_label = K.squeezed(text).isin(*QUANTITY_LABELS) & (F.length(text) <= QUANTITY_LABEL_LETTERS)
        page = page.withColumn("quantities_at", F.min(F.when(is_label, place)).over(whole))
        behind = (place > F.col("quantities_at")) & (place <= F.col("quantities_at") + n * LINES_A_ROW)
        number = F.when(behind, K.squeezed(fix_digits(text, "invoice")))
        number = F.when(number.rlike(r"^[0-9]{1,4}$"), number.try_cast("int"))
        held += [F.min(F.when(behind & text.rlike("(?U)" + QUANTITY_END), place)).alias("ended"), among(number.between(1, 9999), number.cast("string")).alias("quantities")]
        values["quantity"] = F.slice(F.filter("quantities", lambda v: F.col("ended").isNull() | (v["place"] < F.col("ended"))), F.lit(1), n)
    for key in (k for k in keys if k in digits):
        is_label = (K.squeezed(text) == label[key]) & (F.length(text) <= LABEL_LETTERS)
        page = page.withColumn(f"{key}_at", F.max(F.when(is_label, place)).over(whole))
        behind = (place > F.col(f"{key}_at")) & (place <= F.col(f"{key}_at") + n * LINES_A_ROW)
        held.append(among(behind & text.rlike(AMOUNT) & (F.length(F.regexp_replace(text, r"\D", "")) >= digits[key]), text).alias(f"{key}_found"))
        values[key] = F.when(F.size(f"{key}_found") >= n, F.slice(f"{key}_found", F.lit(1), n))
    found = page.groupBy("doc_id").agg(*held)
    kept = [c for c in found.columns if c not in ("codes", "quantities", "ended", "n", *(f"{k}_found" for k in keys))]
    return found.select(*kept, *(F.transform(F.when(F.size(v) > 0, v), lambda x: x["value"]).alias(f"found_{k}") for k, v in values.items()))


#: Labels and least digits of keys whose values are grouped numbers.
LABELS, DIGITS = {"unitPrice": PRICE_LABEL, "amount": AMOUNT_LABEL}, {"unitPrice": 2, "amount": 4}


def _one(ordered: DataFrame, sizes: DataFrame, key: str, label: dict[str, str] = LABELS, digits: dict[str, int] = DIGITS) -> DataFrame:
    found = _blocks(ordered.join(sizes, "doc_id"), (key,), label, digits, ("place",))
    return found.select("doc_id", F.posexplode(f"found_{key}").alias("seq", "value"))


def code_block(ordered: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, seq, value: the first run of lines, all codes of capitals and digits, that is as long as the table; its first lines.

    ``sizes``: doc_id, n.
    """
    return _one(ordered, sizes, "itemCode")


def amounts_after(ordered: DataFrame, sizes: DataFrame, label: str, least_digits: int) -> DataFrame:
    """doc_id, seq, value: the first grouped numbers behind the last line that is the label, if there are as many as rows."""
    return _one(ordered, sizes, "amount", {"amount": label}, {"amount": least_digits})


def quantities_after(ordered: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, seq, value: numbers from 1 to 9999 behind the first line that is a label of quantities, up to a word that ends them."""
    return _one(ordered, sizes, "quantity")


def searched_blocks(lines: DataFrame, rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each table: doc_id, rows (in order), n, searched, order, and want_ and found_ + key.

    ``searched``: two rows or more that lack half of the cells of a key (``want_``); ``order``: the rows in the order in which their
    names are read, null where not all are found; ``found_``: the values of the keys that are wanted, in that order (null: none).
    Lines and rows meet by document alone, so both are dealt out once.
    """
    missing = [F.sum(F.when(F.trim(K.text_of(F.col(k))) == "", 1).otherwise(0)).alias(f"no_{k}") for k in keys]
    tables = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("row_idx", *(c for c in rows.columns if c not in ("doc_id", "row_idx"))))).alias("rows"), F.count(F.lit(1)).cast("int").alias("n"), *missing)
    wants = [(F.col(f"no_{k}") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).alias(f"want_{k}") for k in keys]
    tables = tables.select("doc_id", "rows", "n", *wants).withColumn("searched", F.col("doc_id").isNotNull() & (F.col("n") >= 2) & reduce(Column.__or__, [F.col(f"want_{k}") for k in keys]))
    names = tables.where("searched").select("doc_id", "n", _names(F.col("rows")).alias("names"))
    page = lines.select("doc_id", "cy", "x", "line_idx", K.clean_value(F.col("text")).alias("text")).join(names, "doc_id")
    page = page.select("doc_id", "cy", "x", "line_idx", "text", "n", _near(F.col("text"), F.col("names")).alias("near"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("cy", "x", "line_idx")) - 1
    texts = F.array_sort(F.collect_list(F.when(F.col("near"), F.struct("place", "text")))).alias("texts")
    found = _blocks(page.withColumn("place", place), keys, LABELS, DIGITS, ("cy", "x", "line_idx"), texts)
    pages = tables.join(found, "doc_id", "left").withColumn("order", F.when(F.col("searched"), _order(F.col("texts"), _names(F.col("rows")))))
    wanted = [F.when(F.col("order").isNotNull() & F.col(f"want_{k}"), F.col(f"found_{k}")).alias(f"found_{k}") for k in keys]
    return pages.select("doc_id", "rows", "n", "searched", "order", *(f"want_{k}" for k in keys), *wanted)


def recovered(lines: DataFrame, rows: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``rows`` with the empty cells of ``keys`` filled from blocks of lines, where a block is as long as the table.

    ``rows``: doc_id, row_idx (from 0), itemName and ``keys``; ``lines``: doc_id, line_idx, x, cy, text. A key is looked for in
    tables of two rows or more where half of its cells are empty, and filled only where all names are found on the page.
    Adds ``filled`` (the keys filled in the row) and ``warnings`` (of the table: mapping, or what was not found).
    """
    pages = searched_blocks(lines, rows, keys)
    # rows of a table whose names are all found have distinct numbers, so values sorted by them stand beside their rows
    new = F.array_sort(F.transform("order", lambda r, i: F.struct(r.alias("row_idx"), *(F.get(f"found_{k}", i).alias(k) for k in keys))))
    counts = [F.coalesce(F.size(f"found_{k}"), F.lit(0)).alias(f"n_{k}") for k in keys]
    counts = [F.greatest(c, F.lit(0)).alias(f"n_{k}") for c, k in zip(counts, keys)]
    both = F.arrays_zip("rows", F.coalesce(new, F.array().cast(f"array<struct<row_idx:int,{','.join(f'`{k}`:string' for k in keys)}>>")).alias("new"))
    out = pages.select("doc_id", "n", "searched", F.col("order").isNotNull().alias("mapped"), *(f"want_{k}" for k in keys), *counts, F.explode(both).alias("both"))
    whole = lambda k: F.col("mapped") & F.col(f"want_{k}") & (F.col(f"n_{k}") == F.col("n"))
    fills = {k: whole(k) & (F.trim(K.text_of(F.col(f"both.rows.{k}"))) == "") & F.col(f"both.new.{k}").isNotNull() for k in keys}
    lacking = [F.when(F.col(f"want_{k}") & ~whole(k), F.concat(F.lit(f"{k}:"), F.when((F.lit(k) == "quantity") & (F.col(f"n_{k}") > 0), "ambiguous_numeric_candidates").otherwise("source_missing"), F.lit(":"), F.col(f"n_{k}").cast("string"), F.lit("/"), F.col("n").cast("string"))) for k in keys]
    out = out.withColumn("filled", F.array_compact(F.array(*(F.when(f, F.lit(k)) for k, f in fills.items()))))
    out = out.withColumn("applied", F.max(F.size("filled")).over(Window.partitionBy("doc_id")) > 0)
    warnings = F.when(~F.col("searched"), F.array().cast("array<string>")).when(~F.col("mapped"), F.array(F.lit("multiline_layout_order_mismatch")))
    warnings = warnings.otherwise(F.array_compact(F.concat(F.array(F.when(F.col("applied"), F.lit("multiline_layout_mapping_applied"))), F.array(*lacking))))
    cell = lambda c: F.col("doc_id") if c == "doc_id" else F.when(fills[c], F.col(f"both.new.{c}")).otherwise(F.col(f"both.rows.{c}")).alias(c) if c in keys else F.col(f"both.rows.{c}").alias(c)
    return out.select(*map(cell, rows.columns), "filled", warnings.alias("warnings"))
