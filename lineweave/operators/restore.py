"""Entity restoration: known records suggest fields of new ones by business number; ranked, applied, counted, upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.text import meaningless

#: Weight of each source of suggestions.
SOURCE_BONUS = {"profile": 0.03, "history": 0.01, "ground_truth": 0.02}
#: Fields that are never filled without a person.
NEVER_APPLIED = ("totalAmount",)


def profile_candidates(profiles: DataFrame, fields: tuple[str, ...], source: str = "profile") -> DataFrame:
    """(biz, field, value, source, updated_at) of filled profile fields; one narrow explode."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))
    long = profiles.select("biz", "updated_at", F.explode(pairs).alias("p")).select("biz", "p.field", "p.value", F.lit(source).alias("source"), "updated_at")
    return long.where(~meaningless(F.col("value")))


def suggestions(candidates: DataFrame) -> DataFrame:
    """One row for each (biz, field, value): hits and confidence 0.9 + the source's bonus + 0.012 for each further hit, 1 at most."""
    bonus = F.create_map(*(F.lit(x) for kv in SOURCE_BONUS.items() for x in kv))[F.col("source")]
    grouped = candidates.groupBy("biz", "field", "value").agg(F.count(F.lit(1)).alias("hits"), F.max(F.coalesce(bonus, F.lit(0.0))).alias("bonus"), F.max("updated_at").alias("updated_at"))
    return grouped.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.9 + F.col("bonus") + 0.012 * (F.least(F.col("hits"), F.lit(5)) - 1)), 4)).drop("bonus")


def top_suggestion(records: DataFrame, suggested: DataFrame) -> DataFrame:
    """For each field of each record (record_id, biz, field, value) the best suggestion and what to do with it.

    Actions: apply (field empty, allowed, confidence 0.9 or more), review (allowed not), keep (value agrees), conflict.
    The many records of one business join its few best rows: the rank is taken before the join.
    """
    best = Window.partitionBy("biz", "field").orderBy(F.desc("confidence"), F.desc("hits"), F.desc("updated_at"), "value")
    one = suggested.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("biz", "field", F.col("value").alias("suggested"), "confidence", "hits")
    empty = meaningless(F.col("value"))
    action = (
        F.when(F.col("suggested").isNull(), "none")
        .when(empty & ~F.col("field").isin(*NEVER_APPLIED) & (F.col("confidence") >= 0.9), "apply")
        .when(empty, "review")
        .when(F.trim("value") == F.trim("suggested"), "keep")
        .otherwise("conflict")
    )
    return records.join(one, ["biz", "field"], "left").withColumn("action", action)


def action_counts(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("field", "action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("biz").alias("n_biz"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; columns of ``old``. ``new`` has one row for each key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def merge_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full outer merge in which blank new values never erase: coalesce(nullif(new, ''), old)."""
    fresh = new.select(*keys, *(F.when(~meaningless(F.col(f)), F.col(f)).alias(f"__{f}") for f in fields))
    return old.join(fresh, keys, "full_outer").select(*keys, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))
