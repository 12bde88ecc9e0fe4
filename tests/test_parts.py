"""Functions, sources, stores and the stream on small invented tables."""

import json
import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.operators import amounts, evaluate, history, parties, restore, rows, tables
from lineweave.sources import json as sources
from lineweave.sources import shared
from lineweave.streaming import log


def each(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    got = each(spark, T.best_tokens, ["합계 33.000 원", "1:750", "2024-01-05 12:30", "12345", "12-3456-7890", "O,5OO 12,000원 12,000", None, ""])
    plain = [None if g is None else [(t.value, t.pattern) for t in g] for g in got]
    assert plain == [[(33000, "comma")], [(1750, "ocr_colon")], [], [(12345, "bare")], [], plain[5], None, []]
    assert (12000, "comma") in plain[5]


def test_identifiers(spark):
    assert each(spark, T.biz_valid, ["123-45-67891", "1234567890", "", None]) == [True, False, False, False]
    assert each(spark, T.biz_extract, ["no 1234567891 x", "none"]) == ["123-45-67891", None]
    assert each(spark, T.phone_format, ["0212345678", "02-123-4567", "0311234567", "01012345678", "15881234"]) == ["02-1234-5678", "02-123-4567", "031-123-4567", "010-1234-5678", "1588-1234"]
    assert each(spark, T.phone_valid, ["0212345678", "0012345678", "123", None]) == [True, False, False, False]


def test_dates_and_cells(spark):
    assert each(spark, T.date_normalise, ["2024년 3월 5일", "24-3-5", "71.12.31", "no 20240305", "none"]) == ["2024-03-05", "2024-03-05", "1971-12-31", "2024-03-05", None]
    assert each(spark, T.cell, [" a​b ", "x–y", None]) == ["ab", "x-y", ""]
    assert each(spark, T.meaningless, ["-", " N/A ", "0", None]) == [True, True, False, True]
    assert each(spark, lambda c: T.shortened(c, 8), ["a  b", "abcdefghij"]) == ["a b", "abcde..."]
    # as the rules read: a label without a number and a company word are plain text, a blank line is other, and a
    # number that begins with 0 is none of a business but holds two digits thrice, like a date
    texts = [None, "", "  ", "사업자 1", "123-45-67890", "012-34-56789", "(02)555-1234", "서울 중구", "2024-01-02", "33,000", "주식회사", "영수증 33,000", "cu 편의", "가나다", "x1"]
    kinds = ["empty", "empty", "other", "other", "biz_number", "date", "phone", "address", "date", "amount_like", "text_candidate", "noise_label", "merchant_hint", "text_candidate", "other"]
    assert each(spark, T.category, texts) == kinds


def lines(spark, rows_):
    return spark.createDataFrame([Row(doc_id=d, line_idx=i, text=t, conf=0.9, w=float(w), h=float(h), cx=float(cx), cy=float(cy)) for d, i, t, w, h, cx, cy in rows_])


def test_row_clustering(spark):
    across = [("a", 0, "x", 50, 20, 10, 10), ("a", 1, "y", 50, 20, 90, 25), ("a", 2, "z", 50, 20, 10, 40.1), ("b", 0, "one", 9, 9, 1, 1)]
    got = {(r.doc_id, r.line_idx): r.row_idx for r in rows.cluster_rows(lines(spark, across)).collect()}
    assert got == {("a", 0): 0, ("a", 1): 0, ("a", 2): 1, ("b", 0): 0}
    down = [("v", i, str(i), 20, 200, 10 + 30 * i, 100) for i in range(3)]
    assert {r.row_idx for r in rows.cluster_rows(lines(spark, down)).collect()} == {0, 1, 2}
    text = {r.row_idx: r.row_text for r in rows.row_texts(rows.cluster_rows(lines(spark, across))).where("doc_id = 'a'").collect()}
    assert text == {0: "x y", 1: "z"}
    running = {r.line_idx: r.row_idx for r in rows.cluster_rows_running(lines(spark, across)).where("doc_id = 'a'").collect()}
    assert running == {0: 0, 1: 0, 2: 1}


def test_receipt_total(spark):
    receipt = [("r", 0, "가게", 60, 20, 50, 10), ("r", 1, "공급가액 10,000", 90, 20, 50, 50), ("r", 2, "부가세 1,000", 90, 20, 50, 90), ("r", 3, "합계 11,000", 90, 20, 50, 130), ("r", 4, "승인번호 12345678", 90, 20, 50, 170)]
    clustered = rows.cluster_rows(lines(spark, receipt))
    found = amounts.candidates(clustered, rows.neighbours(rows.row_texts(clustered)))
    best = amounts.selected(amounts.scored(amounts.merged(found.unionByName(amounts.synthesised(found))))).collect()
    assert [(r.value, r.status) for r in best] == [(11000, "selected")]
    assert [r.doc_id for r in parties.has_vat_triple(found).collect()] == ["r"]
    pair = parties.summary_pairs(found.select("doc_id", "row_idx", "value", "ordinal")).collect()
    assert [(r.supply, r.tax, r.total) for r in pair] == [(10000, 1000, 11000)]


def test_two_parties_take_different_names(spark):
    names = lines(spark, [("d", 5, "A", 9, 9, 100, 100), ("d", 6, "B", 9, 9, 130, 100)])
    anchors = lines(spark, [("d", 1, "x", 9, 9, 110, 100), ("d", 2, "y", 9, 9, 105, 100)])
    got = {r.party: r.text for r in parties.two_parties(anchors, names, 1000, 1000).collect()}
    assert got == {"supplier": "A", "buyer": "B"}


def test_boundaries(spark):
    heads = spark.createDataFrame([("d", "itemName", 0.0, 100.0), ("d", "amount", 200.0, 50.0)], "doc_id string, key string, x double, w double")
    b = {r.key: (r.x_start, r.x_end) for r in tables.boundaries(heads).collect()}
    assert b == {"itemName": (0.0, 150.0), "amount": (150.0, 1e9)}
    cells = tables.assign_columns(lines(spark, [("d", 0, "n", 9, 9, 149, 1), ("d", 1, "5", 9, 9, 150, 1)]), tables.boundaries(heads))
    assert {r.line_idx: r.key for r in cells.collect()} == {0: "itemName", 1: "amount"}


def test_upsert_and_history(spark):
    old = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "u"), (3, "c", "u")], "k int, v string, w string")
    assert sorted(map(tuple, restore.upsert(old, new, ["k"]).collect())) == [(1, "a", "t"), (2, "B", "u"), (3, "c", "u")]
    merged = restore.merge_fields(old, spark.createDataFrame([(1, "-", "new")], "k int, v string, w string"), ["k"], ["v", "w"])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "new"), (2, "b", "t")]
    patch = spark.createDataFrame([(2, None, "z")], "k int, v string, w string")
    assert sorted(map(tuple, history.patched(old, patch, "k").collect())) == [(1, "a", "t"), (2, "b", "z")]


def test_verdicts(spark):
    schema = "filename string, doc_type string, selected boolean, missing int, row_status string"
    before = spark.createDataFrame([("a", "t", True, 2, "exact"), ("b", "t", True, 2, "short"), ("c", "t", True, 1, "exact"), ("d", "t", True, 1, "short"), ("gone", "t", True, 1, "short")], schema)
    after = spark.createDataFrame([("a", "t", True, 2, "exact"), ("b", "t", True, 1, "exact"), ("c", "t", False, 1, "exact"), ("d", "t", True, 2, "exact"), ("fresh", "t", True, 1, "short")], schema)
    assert {r.filename: r.verdict for r in evaluate.diff_samples(before, after).collect()} == {"a": "unchanged", "b": "improved", "c": "regressed", "d": "mixed", "gone": "removed", "fresh": "new"}


def test_json_stores(spark, tmp_path):
    schema = "id string, n int"
    assert sources.read_array(spark, str(tmp_path / "none.json"), schema).count() == 0
    path = tmp_path / "a.json"
    path.write_bytes("﻿".encode() + json.dumps([{"id": "x", "n": 1}, {"id": "y"}], indent=2).encode())
    assert sorted(map(tuple, sources.read_array(spark, str(path), schema).collect())) == [("x", 1), ("y", None)]
    rows_ = spark.createDataFrame([("a", 1)], schema)
    sources.append_log(rows_, str(tmp_path / "log"))
    sources.append_log(rows_, str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("{broken\n\n")
    assert sources.read_log(spark, str(tmp_path / "log"), schema).count() == 2


def test_recognised_lines(spark):
    p = [Row(x=0.0, y=0.0), Row(x=4.0, y=0.0), Row(x=4.0, y=2.0), Row(x=0.0, y=2.0)]
    flat = [Row(x=0.0, y=0.0)] * 4
    df = spark.createDataFrame([Row(doc_id="d", rec_texts=["a", " ", "c"], rec_scores=[0.9, 0.8, 0.7], rec_polys=[p, p, flat])])
    got = rows.geometry(sources.recognised_lines(df)).collect()
    assert [(r.text, r.conf, r.w, r.h, r.cx) for r in got] == [("a", 0.9, 4.0, 2.0, 2.0)]


def test_stream(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for i, times in enumerate((["2024-01-01T00:10:00", "2024-01-01T00:50:00"], ["2024-01-01T05:00:00"], ["2024-01-01T06:00:00"], ["2024-01-01T00:20:00", "2024-01-01T09:00:00"])):
        (tmp_path / f"{i}.json").write_text("\n".join(json.dumps({"ts": t, "event_type": "e", "value": 1.0}) for t in times))
        os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = log.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.table("windows").orderBy("start").collect()][0] == (2, 2.0)  # the late row is left out
    table = log.windowed_counts(spark.read.schema(schema).json(str(tmp_path)))
    assert sorted(r.n for r in table.collect()) == [1, 1, 1, 3]


def test_corrections(spark):
    e = spark.createDataFrame([("i", "auto_extract", "2024-01-01 00:00:00", "t"), ("i", "human_correction", "2024-01-01 00:30:00", None), ("i", "human_correction", "2024-01-01 03:00:00", None)], "image_id string, event_type string, ts string, doc_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert log.corrections(e).count() == 1


@pytest.mark.parametrize("gone", [["lineweave.llm.queries"], ["corpus_pipeline"]])
def test_entry_without_the_subpackage(gone):
    code = f"""
import importlib.util as u
find = u.find_spec
u.find_spec = lambda name, *a: None if name in {gone!r} else find(name, *a)
import __spark_entry__ as e
q = e.queries()
assert 'amount_select_top1' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_of_a_copy_without_the_folders(gone, tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy, there = tmp_path / "copy", os.path.isdir(os.path.join(here, "lineweave", "llm"))
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__", *gone))
    code = f"""
import __spark_entry__ as e
q = e.queries()
assert e.__file__.startswith({str(copy)!r})
assert 'amount_select_top1' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)
assert ('op2_bpe' in q) == {there and "llm" not in gone!r} and e.MISSING
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)})


def test_shared_folder_needs_a_setting_on_clusters():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared.shared_dir(cluster)


def test_long_templates_are_refused(spark):
    lines = spark.createDataFrame([(1, 0, 5.0)], "doc_id long, line_idx int, cx double")
    bounds = spark.range(tables.TEMPLATE_ROWS + 1).selectExpr("cast(id as string) key", "10D * id x_start", "10D * id + 10 x_end", "10D * id + 5 header_cx")
    assert [r.key for r in tables.assign_columns(lines, bounds.where("x_start < 100")).collect()] == ["0"]
    with pytest.raises(ValueError):
        tables.assign_columns(lines, bounds)
