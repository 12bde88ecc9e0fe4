"""Drafts of ground truth: recognised fields and table rows with what a reviewer has edited, and stores of older versions.

Edits meet their base by key or by position in outer joins; each page's order and warnings are windows and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions.tokens import text_of

#: Cells of a draft row, and the names of columns that stand for them.
FIELD_KEYS = ("itemName", "spec", "productCode", "lotNo", "expiryDate", "quantity", "unitPrice", "amount")
COLUMN_ALIASES = {
    "itemName": ("itemName", "name", "item"),
    "spec": ("spec",),
    "productCode": ("productCode", "code"),
    "lotNo": ("lotNo", "lot"),
    "expiryDate": ("expiryDate", "exp", "expiry"),
    "quantity": ("quantity", "qty"),
    "unitPrice": ("unitPrice", "price"),
    "amount": ("amount", "total"),
}
#: Fixed value: the type of a record that names none.
DEFAULT_TYPE = "영수증"


def field_status(value: Column, edited: Column) -> Column:
    return F.when(value == "", "not_reviewed").when(edited, "present_corrected").otherwise("present_extracted")


def merged_fields(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Base fields in their order with the values of edits, then fields that only edits have, in the order in which they came.

    ``base``: doc_id, place, key (once a document), originalValue, value, edited, confidence, labelKo, labelEn. ``edits``: doc_id, seq,
    key, value, confidence, labelKo, labelEn; blank keys are left out, a null value is empty. Of several edits of a key the last
    gives the value; a new field has confidence and labels from the first. A field counts as edited where its value
    differs from the original one.

    Returns ``base``'s columns with ``place`` numbered from 0 and ``fieldStatus``.
    """
    named = edits.where(F.trim(text_of(F.col("key"))) != "")
    label = lambda c: F.when(F.trim(text_of(F.col(c))) != "", F.col(c))
    first = lambda c: F.min_by(F.struct(c.alias("v")), "seq")["v"]
    e = named.groupBy("doc_id", "key").agg(
        F.min("seq").alias("e_seq"), F.max_by(text_of(F.col("value")), "seq").alias("e_value"),
        first(F.col("confidence")).alias("e_confidence"), first(label("labelKo")).alias("e_ko"), first(label("labelEn")).alias("e_en"),
    )
    both = base.withColumn("is_base", F.lit(True)).join(e, ["doc_id", "key"], "full")
    was, old = F.col("e_seq").isNotNull(), F.coalesce("is_base", F.lit(False))
    value, original = F.coalesce("e_value", text_of(F.col("value"))), text_of(F.col("originalValue"))
    edited = F.when(was, value != original).otherwise(F.coalesce("edited", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(old, 0).otherwise(1), F.when(old, F.col("place")).otherwise(F.col("e_seq")))) - 1
    own = lambda c, new: F.when(old, F.col(c)).otherwise(F.col(new)).alias(c)
    return both.select("doc_id", place.alias("place"), "key", original.alias("originalValue"), value.alias("value"), edited.alias("edited"), own("confidence", "e_confidence"), own("labelKo", "e_ko"), own("labelEn", "e_en"), field_status(value, was & edited).alias("fieldStatus"))


def column_key(c: Column) -> Column:
    """The cell that a column's name stands for; null for unknown names."""
    names = F.create_map(*(F.lit(x) for key, aliases in COLUMN_ALIASES.items() for alias in aliases for x in (alias, key)))
    return names[c]


def _pages(rows: DataFrame, edits: DataFrame) -> DataFrame:
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    m = edits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_edits"))
    return n.join(m, "doc_id", "full").select("doc_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_edits", F.lit(0)).alias("n_edits"))


def merged_table(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Draft rows with the cells of edited rows, by position.

    ``rows``: doc_id, rowIndex (from 1) and FIELD_KEYS; ``edits``: doc_id, row_idx (from 0), cells (array of key and value, or null).
    Of several cells that stand for one key the last counts; unknown columns are left out (``table_warnings`` tells).

    Returns doc_id, rowIndex, FIELD_KEYS and ``fieldStatus`` (map of key and status).
    """
    cells = edits.select("doc_id", (F.col("row_idx") + 1).alias("rowIndex"), F.posexplode("cells").alias("at", "c")).select("doc_id", "rowIndex", "at", column_key(F.col("c.key")).alias("key"), text_of(F.col("c.value")).alias("value")).where("key is not null")
    new = cells.groupBy("doc_id", "rowIndex").pivot("key", list(FIELD_KEYS)).agg(F.max_by("value", "at")).select("doc_id", "rowIndex", *(F.col(k).alias(f"new_{k}") for k in FIELD_KEYS))
    both = rows.join(new, ["doc_id", "rowIndex"], "left")
    status = F.create_map(*(x for k in FIELD_KEYS for x in (F.lit(k), F.when(F.col(f"new_{k}").isNotNull(), "present_corrected").otherwise(field_status(text_of(F.col(k)), F.lit(False))))))
    return both.select("doc_id", "rowIndex", *(F.coalesce(f"new_{k}", text_of(F.col(k))).alias(k) for k in FIELD_KEYS), status.alias("fieldStatus"))


def table_warnings(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, warnings, export_blocked for each document with rows or edits: edits without a base table block it; other counts of rows and unknown columns warn."""
    pages = _pages(rows, edits)
    cells = edits.select("doc_id", "row_idx", F.explode("cells").alias("c")).where(column_key(F.col("c.key")).isNull()).groupBy("doc_id").agg(F.min("row_idx").alias("unknown_at"))
    p = pages.join(cells, "doc_id", "left")
    blocked = (F.col("n_edits") > 0) & (F.col("n_rows") == 0)
    told = F.array(F.when((F.col("n_edits") > 0) & (F.col("n_edits") != F.col("n_rows")), "row_count_mismatch"), F.when(F.col("unknown_at") < F.col("n_rows"), "unknown_column_key"))
    return p.select("doc_id", F.when(blocked, F.array(F.lit("no_base_table_for_edits"))).otherwise(F.array_compact(told)).alias("warnings"), blocked.alias("export_blocked"))


# ---- stores of ground truth ----
_MAP = "map<string, string>"


def store_entries(stores: DataFrame) -> DataFrame:
    """``dataset``, key, entry of every object in JSON stores (``dataset``, ``json``: an object of records); ``entry`` is null for a store that is no JSON object."""
    parsed = stores.withColumn("m", F.from_json("json", _MAP))
    whole = parsed.where("m is not null").select("dataset", F.explode("m").alias("key", "entry")).where(F.trim("entry").startswith("{"))
    return whole.unionByName(parsed.where("m is null and trim(coalesce(json, '')) <> ''").select("dataset", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("entry")))


def migrated(stores: DataFrame) -> DataFrame:
    """Records of stores of all versions: dataset, key, fields, type, updated_at, financeFields, documentFields, ocr_text, bad.

    Records of the oldest version are the fields themselves; later ones hold them under ``fields``. A record without a type
    is a receipt, without a time ''. ``ocr_text`` (null if none) belongs into the cache table (``cache_of``). A store or a
    record that cannot be read is one row with ``bad``. Numbers as values become texts.
    """
    e = store_entries(stores).withColumn("m", F.from_json("entry", _MAP))
    of = lambda name: F.when(F.trim(F.col("m")[name]).startswith("{"), F.from_json(F.col("m")[name], _MAP))
    fields = F.when(F.map_contains_key("m", "fields"), F.coalesce(of("fields"), F.create_map().cast(_MAP))).otherwise(F.col("m"))
    kept = lambda name: F.nullif(F.col("m")[name], F.lit(""))
    bad = F.col("m").isNull()
    return e.select(
        "dataset", "key", F.when(~bad, fields).alias("fields"), F.when(~bad, F.coalesce(kept("type"), F.lit(DEFAULT_TYPE))).alias("type"), F.when(~bad, F.coalesce(kept("updated_at"), F.lit(""))).alias("updated_at"),
        of("financeFields").alias("financeFields"), of("documentFields").alias("documentFields"), kept("ocr_text").alias("ocr_text"), bad.alias("bad"),
    )


def cache_of(records: DataFrame, cache: DataFrame) -> DataFrame:
    """``cache`` (dataset, key, ocr_text, scanned_at) and the texts of migrated records that it lacks; what is there stays, so that a second run adds nothing."""
    found = records.where(F.col("ocr_text").isNotNull()).select("dataset", "key", "ocr_text", F.col("updated_at").alias("scanned_at"))
    return cache.unionByName(found.join(cache.select("dataset", "key"), ["dataset", "key"], "left_anti"))
