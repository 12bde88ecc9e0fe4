"""Results as JSON and Markdown, built as columns so that sinks write them in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_json(fields: DataFrame, rows: DataFrame, info: list[str], cells: list[str]) -> DataFrame:
    """(doc_id, json): ``{"info": {...}, "tables": [{...}, ...]}``, rows in order of row_idx; documents without rows keep an empty table."""
    table = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", *cells))).alias("t"))
    joined = fields.join(table, "doc_id", "left")
    listed = F.transform(F.coalesce("t", F.array().cast(table.schema["t"].dataType)), lambda r: F.struct(*(F.coalesce(r[c], F.lit("")).alias(c) for c in cells)))
    return joined.select("doc_id", F.to_json(F.struct(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in info)).alias("info"), listed.alias("tables"))).alias("json"))


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\r?\n", " ")


def markdown(rows: DataFrame, cells: list[str], title: str = "doc_id") -> DataFrame:
    """(doc_id, report): a heading and one table in order of row_idx."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(escaped(F.col(c)) for c in cells)), F.lit(" |"))
    body = rows.select("doc_id", F.struct("row_idx", line.alias("line")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    head = f"| {' | '.join(cells)} |\n|{'---|' * len(cells)}\n"
    return body.select("doc_id", F.concat(F.lit("## "), F.col(title), F.lit("\n\n" + head), F.array_join(F.transform("rs", lambda r: r["line"]), "\n")).alias("report"))
