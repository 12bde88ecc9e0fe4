"""Lines to rows: geometry, filters, one-dimensional clustering, texts and neighbours. All keyed by ``doc_id``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import compact


def geometry(points: DataFrame, pts: str = "pts") -> DataFrame:
    """Adds x, y, w, h, cx, cy from an array of points; polygons without extent and blank texts go."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    boxed = points.withColumn("x", F.array_min(xs)).withColumn("y", F.array_min(ys)).withColumn("w", F.array_max(xs) - F.col("x")).withColumn("h", F.array_max(ys) - F.col("y"))
    return boxed.where((F.col("w") > 0) & (F.col("h") > 0) & (F.trim("text") != "")).withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)


def confident(lines: DataFrame, conf: float = 0.3, size: float = 5) -> DataFrame:
    return lines.where((F.col("conf") >= conf) & (F.col("w") >= size) & (F.col("h") >= size))


def _upper_median(c: str) -> Column:
    """The upper median of a column in its document: from the large end, the lower one."""
    return F.expr(f"percentile_disc(0.5) within group (order by {c} desc) over (partition by doc_id)")


def cluster_rows(lines: DataFrame) -> DataFrame:
    """Adds ``row_idx``: a new row begins where the centre leaves that of the line before by more than a share of the size.

    Upper medians decide between reading across (0.75 of the height) and down (0.45 of the width). Windows by document
    alone, so lines are dealt out once; ties in the centre go by ``line_idx``.
    """
    down = F.col("mh") > F.greatest(F.col("mw") * 1.8, F.lit(80.0))
    sized = lines.withColumn("mw", _upper_median("w")).withColumn("mh", _upper_median("h")).withColumn("main", F.when(down, F.col("cx")).otherwise(F.col("cy"))).withColumn("side", F.when(down, F.col("cy")).otherwise(F.col("cx")))
    sized = sized.withColumn("gap", F.greatest(F.when(down, F.col("mw") * 0.45).otherwise(F.col("mh") * 0.75), F.lit(8.0)))
    order = Window.partitionBy("doc_id").orderBy("main", "line_idx")
    new = F.when(F.abs(F.col("main") - F.lag("main").over(order)) > F.col("gap"), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sized.withColumn("new", new).withColumn("row_idx", F.sum("new").over(running).cast("int")).drop("mw", "mh", "main", "gap", "new")


def row_texts(clustered: DataFrame, *more: Column) -> DataFrame:
    """One row for each (doc_id, row_idx): its text in order of the second axis, and ``more`` aggregates of its lines."""
    parts = F.array_sort(F.collect_list(F.struct("side", "line_idx", "text")))
    return clustered.groupBy("doc_id", "row_idx").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("row_text"), F.avg("cy").alias("row_cy"), *more)


def neighbours(rows: DataFrame) -> DataFrame:
    """Adds context, near_above, near_below (compact texts) and row_pos in [0, 1]."""
    order = Window.partitionBy("doc_id").orderBy("row_idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    lean = rows.withColumn("context", compact(F.col("row_text")))
    return (
        lean.withColumn("near_above", F.lag("context", 1, "").over(order))
        .withColumn("near_below", F.lead("context", 1, "").over(order))
        .withColumn("row_pos", F.col("row_idx") / F.greatest(n - 1, F.lit(1)))
    )


def cluster_rows_running(lines: DataFrame, factor: float = 0.75, first_fit: bool = False) -> DataFrame:
    """``row_idx`` by the running mean of a row's centres, which depends on the order of lines and so folds a document.

    ``first_fit``: a line joins the first row near enough (threshold within 8 and 24) instead of the open one.
    Documents are sorted by Spark and pass by in batches of lines, which share none of their borders with documents: only the sums of
    a document's rows (the open one's without ``first_fit``) are held from one line to the next.
    """

    def fold(batches):
        doc: object = fold  # no document's id
        rows: list[list[float]] = []  # sum of centres, sum of heights, lines
        gone = 0  # rows that no line can join any more
        for batch in batches:
            at = []
            for of, cy, h, median in zip(batch["doc_id"].tolist(), batch["cy"].tolist(), batch["h"].tolist(), batch["mh"].tolist()):
                if of != doc:
                    doc, rows, gone = of, [], 0
                spot = None
                for i, (total, heights, n) in enumerate(rows):
                    limit = min(max(median * factor, 8), 24) if first_fit else factor * max(heights / n, h)
                    if abs(cy - total / n) <= limit:
                        spot = i
                        break
                if spot is None:
                    if rows and not first_fit:
                        rows, gone = [], gone + 1
                    rows.append([0.0, 0.0, 0])
                    spot = len(rows) - 1
                row = rows[spot]
                row[0], row[1], row[2] = row[0] + cy, row[1] + h, row[2] + 1
                at.append(gone + spot)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "line_idx": batch["line_idx"], "row_idx": at})

    # the median's window is what keeps a document in one task
    sized = lines.select("doc_id", "line_idx", "cx", "cy", "h").withColumn("mh", _upper_median("h"))
    return sized.sortWithinPartitions("doc_id", "cy", "cx", "line_idx").mapInPandas(fold, "doc_id string, line_idx int, row_idx int")


def merge_bands(bands: DataFrame, gap: float = 4.0) -> DataFrame:
    """Union of vertical bands (top, bottom) that overlap or lie within ``gap``: doc_id, band, top, bottom, n."""
    order = Window.partitionBy("doc_id").orderBy("top", "bottom")
    reach = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = bands.withColumn("new", F.when(F.col("top") <= reach + gap, 0).otherwise(1))
    island = flagged.withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy("doc_id", "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("n"))


def dedup_rows(rows: DataFrame) -> DataFrame:
    """The first row of each canonical text in a document."""
    key = F.lower(F.regexp_replace("row_text", r"[\s\p{Punct}]+", ""))
    order = Window.partitionBy("doc_id", "canon").orderBy("row_idx")
    return rows.withColumn("canon", key).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def stop_at(rows: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """Rows above the first that contains a stop keyword, white space aside."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(F.regexp_replace("row_text", r"\s+", ""), F.lit(k.replace(" ", "")))
    stop = F.min(F.when(hit, F.col("row_idx"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("row_idx") < F.col("stop"))).drop("stop")


def sessionise(rows: DataFrame, start: str) -> DataFrame:
    """Rows in groups that each begin where the text matches ``start``; rows before the first are left out."""
    order = Window.partitionBy("doc_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = rows.withColumn("item", F.sum(F.when(F.col("row_text").rlike(start), 1).otherwise(0)).over(order)).where("item > 0")
    parts = F.array_sort(F.collect_list(F.struct("row_idx", "row_text")))
    return grouped.groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(parts, lambda p: p["row_text"]), " | ").alias("item_text"))
