"""Evaluation: ground truth, run-to-run differences, roll-ups, variant guards and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Verdicts in order of urgency.
VERDICTS = ("regressed", "mixed", "improved", "unchanged", "new", "removed")


def gt_status(value: Column, truth: Column) -> Column:
    """none without ground truth, else match or mismatch of trimmed texts."""
    t = F.trim(F.coalesce(truth, F.lit("")))
    return F.when(t == "", "none").when(F.trim(F.coalesce(value, F.lit(""))) == t, "match").otherwise("mismatch")


def gt_match_rate(compared: DataFrame, by: str) -> DataFrame:
    """Counts and match rate (4 decimals, null without ground truth) by group."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    known = n("match") + n("mismatch")
    return compared.groupBy(by).agg(n("match").alias("matched"), n("mismatch").alias("mismatched"), n("none").alias("unknown"), F.round(F.try_divide(n("match").cast("double"), known), 4).alias("match_rate"))


def diff_samples(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer difference of two runs (filename, doc_type, selected, missing, warnings, row_status): a verdict each.

    Better: newly selected, fewer missing fields or row count now exact; worse: the reverse; both is mixed.
    """
    b = before.select("filename", *(F.col(c).alias(f"b_{c}") for c in ("doc_type", "selected", "missing", "row_status")))
    a = after.select("filename", *(F.col(c).alias(f"a_{c}") for c in ("doc_type", "selected", "missing", "row_status")))
    j = b.join(a, "filename", "full_outer")
    exact = lambda s: F.col(f"{s}_row_status") == "exact"
    better = (F.col("a_selected") & ~F.col("b_selected")) | (F.col("a_missing") < F.col("b_missing")) | (exact("a") & ~exact("b"))
    worse = (F.col("b_selected") & ~F.col("a_selected")) | (F.col("a_missing") > F.col("b_missing")) | (exact("b") & ~exact("a"))
    verdict = (
        F.when(F.col("b_doc_type").isNull(), "new")
        .when(F.col("a_doc_type").isNull(), "removed")
        .when(better & worse, "mixed")
        .when(better, "improved")
        .when(worse, "regressed")
        .otherwise("unchanged")
    )
    return j.select("filename", F.coalesce("a_doc_type", "b_doc_type").alias("doc_type"), (F.col("a_missing") - F.col("b_missing")).alias("missing_delta"), verdict.alias("verdict"))


def verdict_rollup(diff: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict")).cast("int")
    return diff.groupBy("doc_type", "verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("urgency", rank)


def diff_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts (column n) differ: before, after, delta."""
    j = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), keys, "full_outer").fillna(0, ["before", "after"])
    return j.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def select_variant(original: DataFrame, variants: DataFrame) -> DataFrame:
    """First accepted variant of each document in order of ``pos``, else the original.

    Both have doc_id, n_filled, total (amount found); variants also pos and name. A variant is accepted if it fills more
    fields and keeps the amount; it is rejected if any is lost.
    """
    o = original.select("doc_id", F.col("n_filled").alias("o_filled"), F.col("total").alias("o_total"))
    accept = (F.col("n_filled") > F.col("o_filled")) & (F.coalesce("o_total", F.lit(0)) <= F.coalesce("total", F.lit(0)))
    first = variants.join(o, "doc_id").where(accept).groupBy("doc_id").agg(F.min(F.struct("pos", "name", "n_filled")).alias("v"))
    return o.join(first, "doc_id", "left").select("doc_id", F.coalesce("v.name", F.lit("original")).alias("chosen"), F.coalesce("v.n_filled", "o_filled").alias("n_filled"))


def release_gate(rows: DataFrame, large: int = 20) -> DataFrame:
    """Ratios of usable cells of each document's table against gates that are stricter for small tables.

    ``rows``: doc_id, has_name, has_quantity, has_amount, forbidden (booleans). Returns ratios, ``ready`` and the gates
    that failed.
    """
    share = lambda c: F.avg(F.col(c).cast("double"))
    g = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), share("has_name").alias("name_ratio"), share("has_quantity").alias("quantity_ratio"), share("has_amount").alias("amount_ratio"), F.sum(F.col("forbidden").cast("long")).alias("n_forbidden"))
    # Gates for large and small tables.
    gate = lambda big, small: F.when(F.col("n_rows") >= large, big).otherwise(small)
    failed = F.concat_ws(
        ",",
        F.when(F.col("name_ratio") < gate(0.95, 0.99), "name"),
        F.when(F.col("quantity_ratio") < gate(0.8, 0.99), "quantity"),
        F.when(F.col("amount_ratio") < gate(0.95, 0.99), "amount"),
        F.when(F.col("n_forbidden") > 0, "forbidden"),
    )
    return g.withColumn("failed", failed).withColumn("ready", F.col("failed") == "")


def drop_reasons(rows: DataFrame, reasons: dict[str, Column], preview: str) -> DataFrame:
    """Counts of rows by the first reason that holds, with the least preview text; rows without a reason stay out."""
    chain = F
    for name, when in reasons.items():
        chain = chain.when(when, name)
    return rows.withColumn("reason", chain.otherwise(None)).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min(preview).alias("example"))


def first_tier(models: DataFrame) -> DataFrame:
    """All rows of the lowest tier of each document, ties kept."""
    return models.withColumn("rk", F.rank().over(Window.partitionBy("doc_id").orderBy("tier"))).where("rk = 1").drop("rk")


#: Preprocessing variants that each quality tag asks for, in order.
VARIANTS = {"low_contrast": ("clahe",), "skewed": ("deskew",), "blur": ("sharpen",), "small_text": ("upscale",)}


def candidate_variants(samples: DataFrame, tags: str = "quality_tags", kind: str = "doc_type") -> DataFrame:
    """Adds ``variants``: those of the tags, in order and without repeats; invoices also try a table crop."""
    each = [F.when(F.array_contains(tags, tag), F.array(*map(F.lit, names))) for tag, names in VARIANTS.items()]
    each.append(F.when(F.col(kind) == "invoice_statement", F.array(F.lit("table_crop"))))
    return samples.withColumn("variants", F.array_distinct(F.flatten(F.array_compact(F.array(*each)))))
