"""Table headers and free-form rows: header words to canonical keys, best header row, x clusters, rows parsed from the right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header words of canonical columns, in order of precedence.
HEADER_WORDS = (("itemCode", r"품목코드|상품코드|코드"), ("itemName", r"품목|품명|상품명|(?i)item"), ("spec", r"규격|사양"), ("lotNo", r"(?i)lot|로트"), ("expiryDate", r"유효기간|유통기한"), ("quantity", r"수량|(?i)qty"), ("unitPrice", r"단가"), ("supplyAmount", r"공급가액"), ("taxAmount", r"세액|부가세"), ("amount", r"금액|(?i)amount"), ("remark", r"비고"))


def header_key(c: Column) -> Column:
    """Canonical key of a header cell, or null."""
    squeezed = F.regexp_replace(c, r"\s+", "")
    chain = F
    for key, pattern in HEADER_WORDS:
        chain = chain.when(squeezed.rlike(pattern), key)
    return chain.otherwise(None)


def best_header_row(clustered: DataFrame, expected: tuple[str, ...], least: int = 2) -> DataFrame:
    """(doc_id, row_idx, score): most distinct expected keys, one more each for item name and quantity; ties to the upper row."""
    keyed = clustered.withColumn("key", header_key(F.col("text"))).where(F.col("key").isin(*expected) & ~F.col("text").rlike(r"\d"))
    bonus = F.max((F.col("key") == "itemName").cast("int")) + F.max((F.col("key") == "quantity").cast("int"))
    scored = keyed.groupBy("doc_id", "row_idx").agg((F.countDistinct("key") + bonus).cast("int").alias("score")).where(F.col("score") >= least)
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "row_idx")
    return scored.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def below_header(clustered: DataFrame, header: DataFrame) -> DataFrame:
    """Lines of rows under each document's header row."""
    return clustered.join(header.select("doc_id", F.col("row_idx").alias("header_idx")), "doc_id").where("row_idx > header_idx").drop("header_idx")


def x_clusters(lines: DataFrame, gap: float) -> DataFrame:
    """Vertical bands of lines: a new one where the centre leaves that of the line before by more than ``gap``."""
    order = Window.partitionBy("doc_id").orderBy("cx", "line_idx")
    new = F.when(F.col("cx") - F.lag("cx").over(order) > gap, 1).otherwise(0)
    marked = lines.withColumn("new", new)
    return marked.withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")).drop("new")


def parse_row_text(rows: DataFrame) -> DataFrame:
    """item_name, quantity, amount from a row's text: words before the first number; numbers from the right are amount and quantity."""
    tokens = F.split(F.trim("row_text"), r"\s+")
    number = lambda x: x.rlike(r"^[0-9][0-9,]*$")
    numbers = F.filter(tokens, number)
    first = F.aggregate(tokens, F.struct(F.lit(0).alias("n"), F.lit(False).alias("done")), lambda a, x: F.when(a["done"] | number(x), F.struct(a["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct((a["n"] + 1).alias("n"), F.lit(False).alias("done"))))["n"]
    name = F.array_join(F.slice(tokens, F.lit(1), first), " ")
    from_right = lambda i: F.when(F.size(numbers) >= i, F.try_element_at(numbers, F.lit(-i)))
    return rows.where((first > 0) & (F.size(numbers) >= 2)).select("doc_id", "row_idx", name.alias("item_name"), from_right(2).alias("quantity"), from_right(1).alias("amount"))


def token_class(c: Column) -> Column:
    """Class of a number-like token: date, biz_number, phone, money, code, quantity, digits, or null without digits."""
    return (
        F.when(~c.rlike(r"\d"), None)
        .when(c.rlike(r"^(19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}$"), "date")
        .when(c.rlike(r"^\d{3}-\d{2}-\d{5}$"), "biz_number")
        .when(c.rlike(r"^0\d{1,2}-\d{3,4}-\d{4}$"), "phone")
        .when(c.rlike(r"^\d{1,3}(,\d{3})+$"), "money")
        .when(c.rlike(r"[A-Za-z#]"), "code")
        .when(c.rlike(r"^\d{1,4}$"), "quantity")
        .otherwise("digits")
    )


def box_union(lines: DataFrame, by: str = "doc_id") -> DataFrame:
    """Smallest box around the lines of each group."""
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return lines.groupBy(by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"))


def snapshot_summary(lines: DataFrame) -> DataFrame:
    """Lines, mean confidence (4 decimals, half to even) and lines in the upper, middle and lower part of each document."""
    page = lines.withColumn("y_ratio", (F.col("y") + F.col("h") / 2) / F.max(F.col("y") + F.col("h")).over(Window.partitionBy("doc_id")))
    count = lambda c: F.sum(c.cast("long"))
    y = F.col("y_ratio")
    return page.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.bround(F.avg("conf"), 4).alias("avg_conf"), count(y < 0.3).alias("upper"), count((y >= 0.3) & (y < 0.7)).alias("middle"), count(y >= 0.7).alias("lower"))
