"""Records of runs: joins of history and index, filters, tails, inserts, updates and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_index(history: DataFrame, index: DataFrame, key: str, shared: list[str]) -> DataFrame:
    """Full outer join in which the index's values win where it has them; ``indexed`` tells rows that it holds."""
    i = index.select(key, *(F.col(c).alias(f"i_{c}") for c in shared), F.lit(True).alias("indexed"))
    rest = [c for c in history.columns if c not in (key, *shared)]
    return history.join(i, key, "full_outer").select(key, *(F.coalesce(f"i_{c}", c).alias(c) for c in shared), *rest, F.coalesce("indexed", F.lit(False)).alias("indexed"))


def filtered(history: DataFrame, *, keyword: str | None = None, template: str | None = None, since: str | None = None, until: str | None = None, status: str | None = None) -> DataFrame:
    """The conditions that are given, each on one column, so that scans can take them."""
    if keyword:
        history = history.where(F.lower("template_name").contains(keyword.lower()))
    for column, value in (("template_name", template), ("status", status)):
        if value:
            history = history.where(F.col(column) == value)
    day = F.substring("created_at", 1, 10)
    if since:
        history = history.where(day >= since)
    return history.where(day <= until) if until else history


def tail(log: DataFrame, n: int, *order: str, where: Column | None = None) -> DataFrame:
    """The last ``n`` rows by ``order``: a top-n that Spark takes in each task before the driver's merge."""
    log = log if where is None else log.where(where)
    return log.orderBy(*(F.desc(c) for c in order)).limit(n)


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of ``patch`` replace those of ``old`` where they are not null."""
    new = patch.select(key, *(F.col(c).alias(f"p_{c}") for c in patch.columns if c != key))
    return old.join(new, key, "left").select(*(F.coalesce(f"p_{c}", c).alias(c) if c != key and c in patch.columns else c for c in old.columns))


def newest(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def upsert_named(old: DataFrame, new: DataFrame) -> DataFrame:
    """Templates: a new one replaces the stored one with its id, or else with its name, whose id it takes; others are added.

    Both have id, name and body; ids and names are unique on each side.
    """
    by_id = new.join(old.select("id"), "id", "left_semi").withColumn("old_id", F.col("id"))
    rest = new.join(old.select("id"), "id", "left_anti")
    named = rest.join(old.select(F.col("id").alias("old_id"), "name"), "name", "left")
    fresh = by_id.unionByName(named.select(*by_id.columns))
    kept = old.join(fresh.select(F.col("old_id").alias("id")), "id", "left_anti")
    return kept.unionByName(fresh.select(F.coalesce("old_id", "id").alias("id"), "name", "body"))


def capped(history: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """History with ``new`` in front, the newest ``n`` kept."""
    return newest(history.unionByName(new.select(*history.columns)), n)
