"""Drafts and stores: values worked out by hand."""

import json

from pyspark.sql import functions as F

from lineweave.operators import drafts

BASE = "doc_id string, place int, key string, originalValue string, value string, edited boolean, confidence double, labelKo string, labelEn string"
EDIT = "doc_id string, seq int, key string, value string, confidence double, labelKo string, labelEn string"


def test_fields_keep_the_order_of_the_base(spark):
    base = [("d", 0, "b", "1", "1", False, 0.5, "비", None), ("d", 1, "a", "", "", False, None, None, None), ("e", 0, "x", "9", "8", True, 0.1, None, None)]
    edits = [("d", 0, "new", "n", 0.1, "뉴", ""), ("d", 1, "b", "2", 0.9, "x", "x"), ("d", 2, "b", "1", 0.9, "x", "x"), ("d", 3, "new", "", 0.7, "둘", "two"), ("d", 4, "a", "A", None, None, None), ("d", 5, None, "lost", None, None, None), ("f", 0, "z", None, None, " ", "Z")]
    got = sorted(map(tuple, drafts.merged_fields(spark.createDataFrame(base, BASE), spark.createDataFrame(edits, EDIT)).collect()), key=lambda r: r[:2])
    assert got == [
        ("d", 0, "b", "1", "1", False, 0.5, "비", None, "present_extracted"),  # set back to what it was
        ("d", 1, "a", "", "A", True, None, None, None, "present_corrected"),
        ("d", 2, "new", "", "", False, 0.1, "뉴", None, "not_reviewed"),  # the last value, the first labels
        ("e", 0, "x", "9", "8", True, 0.1, None, None, "present_extracted"),
        ("f", 0, "z", "", "", False, None, None, "Z", "not_reviewed"),
    ]


ROW = "doc_id string, rowIndex int, itemName string, spec string, productCode string, lotNo string, expiryDate string, quantity string, unitPrice string, amount string"
CELLS = "doc_id string, row_idx int, cells array<struct<key: string, value: string>>"


def test_cells_by_position(spark):
    rows = [("d", 1, "a", None, "", "", "", "1", "", ""), ("d", 2, "b", "s", "", "", "", "2", "", "")]
    edits = [("d", 1, [("qty", "5"), ("quantity", "6"), ("color", "red"), ("spec", None)]), ("d", 0, None), ("d", 2, [("color", "x")]), ("none", 0, []), ("fits", 0, [("total", "9")])]
    r, e = spark.createDataFrame([*rows, ("fits", 1, "", "", "", "", "", "", "", ""), ("plain", 1, "", "", "", "", "", "", "", "")], ROW), spark.createDataFrame(edits, CELLS)
    got = {(x.doc_id, x.rowIndex): x for x in drafts.merged_table(r, e).collect()}
    assert tuple(got["d", 2])[2:-1] == ("b", "", "", "", "", "6", "", "") and tuple(got["d", 1])[2:-1] == ("a", "", "", "", "", "1", "", "")
    assert {k: got["d", 2].fieldStatus[k] for k in ("itemName", "spec", "quantity", "amount")} == {"itemName": "present_extracted", "spec": "present_corrected", "quantity": "present_corrected", "amount": "not_reviewed"}
    assert got["fits", 1].amount == "9"
    told = {x.doc_id: (x.warnings, x.export_blocked) for x in drafts.table_warnings(r, e).collect()}
    assert told == {"d": (["row_count_mismatch", "unknown_column_key"], False), "none": (["no_base_table_for_edits"], True), "fits": ([], False), "plain": ([], False)}


def test_stores_of_all_versions(spark):
    new = {"fields": {"합계": 12, "b": None}, "type": "t", "updated_at": "u", "ocr_text": "text", "financeFields": {"x": "y"}, "documentFields": 3}
    stores = [("s", json.dumps({"new": new, "old": {"a": "1"}, "number": 5, "list": [1], "null": None, "odd": {"fields": "text"}})), ("bad", "{broken"), ("array", "[1]"), ("empty", ""), ("nothing", None)]
    got = {(r["dataset"], r.key): r for r in drafts.migrated(spark.createDataFrame(stores, "dataset string, json string")).collect()}
    assert set(got) == {("s", "new"), ("s", "old"), ("s", "odd"), ("bad", None), ("array", None)}
    assert [k for k, r in got.items() if r.bad] and {k for k, r in got.items() if r.bad} == {("bad", None), ("array", None)}
    r = got["s", "new"]
    assert (r.fields, r.type, r.updated_at, r.financeFields, r.documentFields, r.ocr_text) == ({"합계": "12", "b": None}, "t", "u", {"x": "y"}, None, "text")
    assert (got["s", "old"].fields, got["s", "old"].type, got["s", "old"].updated_at) == ({"a": "1"}, "영수증", "") and got["s", "odd"].fields == {}


def test_cache_stays_and_fills_once(spark):
    records = drafts.migrated(spark.createDataFrame([("s", json.dumps({"a": {"x": "1", "ocr_text": "A", "updated_at": "u"}, "b": {"ocr_text": "B"}}))], "dataset string, json string"))
    cache = spark.createDataFrame([("s", "a", "kept", "then")], "dataset string, key string, ocr_text string, scanned_at string")
    once = drafts.cache_of(records, cache)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, drafts.cache_of(records, once).collect())) == [("s", "a", "kept", "then"), ("s", "b", "B", "")]
    assert drafts.cache_of(records.where(F.lit(False)), cache).count() == 1
