"""Differences of two runs over samples: by sample, with what became better and worse, and by document type.

A run: filename, doc_type, status, source, row_status (exact, short, over), actual_rows, missing and warnings (arrays of
names). Null arrays count as empty, null counts as 0. File names are unique in a run. All differences are full outer
joins on small keys; names are counted before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.operators.evaluate import diff_counts

SELECTED, EXACT = "selected", "exact"
COUNTS = ("total", "selected", "row_exact", "row_short", "row_over", "warned")


def _size(c: str) -> Column:
    return F.coalesce(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))), F.lit(0))


def sample_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each sample of either run.

    filename, verdict (``new``, ``removed``, ``regressed``, ``mixed``, ``improved``, ``unchanged``), improvements and regressions (arrays
    of texts: row counts, missing fields, status), rows_delta, missing_delta, warning_delta, and whether row_status, status,
    doc_type and source changed (nulls are values). Samples of one run have empty arrays and null deltas and changes.
    """
    names = ("doc_type", "status", "source", "row_status")
    side = lambda run, s: run.select("filename", F.lit(True).alias(f"{s}_in"), *(F.col(c).alias(f"{s}_{c}") for c in names), F.coalesce("actual_rows", F.lit(0)).alias(f"{s}_rows"), _size("missing").alias(f"{s}_missing"), _size("warnings").alias(f"{s}_warnings"))
    j = side(before, "b").join(side(after, "a"), "filename", "full_outer")
    both = F.col("b_in").isNotNull() & F.col("a_in").isNotNull()
    said = lambda label, c: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(f"b_{c}").cast("string"), F.lit("")), F.lit(" → "), F.coalesce(F.col(f"a_{c}").cast("string"), F.lit("")))
    good = lambda s, c, v: F.coalesce(F.col(f"{s}_{c}") == v, F.lit(False))
    gained = lambda c, v: both & good("a", c, v) & ~good("b", c, v)
    lost = lambda c, v: both & good("b", c, v) & ~good("a", c, v)
    some = lambda *texts: F.filter(F.array(*(F.when(w, t) for w, t in texts)), lambda x: x.isNotNull())
    rows, missing, status = said("rowCount", "row_status"), said("missing", "missing"), said("status", "status")
    j = j.withColumn("improvements", some((gained("row_status", EXACT), rows), (both & (F.col("a_missing") < F.col("b_missing")), missing), (gained("status", SELECTED), status)))
    j = j.withColumn("regressions", some((lost("row_status", EXACT), rows), (both & (F.col("a_missing") > F.col("b_missing")), missing), (lost("status", SELECTED), status)))
    better, worse = F.size("improvements") > 0, F.size("regressions") > 0
    verdict = F.when(F.col("b_in").isNull(), "new").when(F.col("a_in").isNull(), "removed").when(better & worse, "mixed").when(better, "improved").when(worse, "regressed").otherwise("unchanged")
    delta = lambda c, name: (F.col(f"a_{c}") - F.col(f"b_{c}")).alias(name)
    changed = [F.when(both, ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))).alias(f"{c}_changed") for c in names]
    return j.select("filename", verdict.alias("verdict"), "improvements", "regressions", delta("rows", "rows_delta"), delta("missing", "missing_delta"), delta("warnings", "warning_delta"), *changed)


def type_counts(run: DataFrame) -> DataFrame:
    """doc_type and its samples: total, selected, row_exact, row_short, row_over, warned (with a warning)."""
    n = lambda c: F.count(F.when(c, 1))
    row = lambda s: n(F.col("row_status") == s)
    return run.groupBy("doc_type").agg(F.count(F.lit(1)).alias("total"), n(F.col("status") == SELECTED).alias("selected"), row("exact").alias("row_exact"), row("short").alias("row_short"), row("over").alias("row_over"), n(_size("warnings") > 0).alias("warned"))


def name_changes(before: DataFrame, after: DataFrame, of: str) -> DataFrame:
    """doc_type, name, before, after, delta: names in the array ``of`` whose counts within a type differ."""
    count = lambda run: run.select(F.coalesce("doc_type", F.lit("")).alias("doc_type"), F.explode(of).alias("name")).where("name is not null").groupBy("doc_type", "name").agg(F.count(F.lit(1)).alias("n"))
    return diff_counts(count(before), count(after), ["doc_type", "name"])


def type_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each type of either run (a null type is the empty one): counts before and after, their deltas, and a verdict.

    ``improved`` where more row counts are exact or fewer fields are missing in all; else ``regressed`` where the reverse
    holds; else ``unchanged``. A type that one run lacks counts 0 there.
    """
    side = lambda run, s: type_counts(run.withColumn("doc_type", F.coalesce("doc_type", F.lit("")))).select("doc_type", *(F.col(c).alias(f"{s}_{c}") for c in COUNTS))
    fields = name_changes(before, after, "missing").groupBy("doc_type").agg(F.sum("delta").alias("missing_delta"))
    j = side(before, "before").join(side(after, "after"), "doc_type", "full_outer").join(fields, "doc_type", "left").fillna(0, [f"{s}_{c}" for s in ("before", "after") for c in COUNTS] + ["missing_delta"])
    j = j.withColumns({f"{c}_delta": F.col(f"after_{c}") - F.col(f"before_{c}") for c in COUNTS[2:]})
    better = (F.col("row_exact_delta") > 0) | (F.col("missing_delta") < 0)
    worse = (F.col("row_exact_delta") < 0) | (F.col("missing_delta") > 0)
    return j.withColumn("verdict", F.when(better, "improved").when(worse, "regressed").otherwise("unchanged"))
