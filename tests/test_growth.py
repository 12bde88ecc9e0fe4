"""What went wrong on larger tables: texts and keys that small tables do not hold."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.operators import amounts as A
from lineweave.operators import parties as P
from lineweave.operators import rows as R
from lineweave.operators import spatial
from lineweave.plans import statements
from lineweave.queries import ORACLES, QUERIES
from lineweave.sources import json as sources


def same(spark, name, folder, **tables):
    """Rows of a query on ``tables``, written to ``folder``, which must be those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(folder))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]}) q").fetchall())
    return rows


def test_lines_of_text_keep_digits_at_their_ends(spark, tmp_path):
    docs = spark.createDataFrame([(1, "0 zero 00\n1 one 11\n  2 two 2 \n\n 33"), (2, None)], "doc_id long, text string")
    assert [r.text for r in sources.text_lines(docs).orderBy("line_idx").collect()] == ["0 zero 00", "1 one 11", "2 two 2", "33"]
    same(spark, "text_cache_lines", tmp_path, documents=docs)


def test_ids_of_new_templates_meet_no_stored_one(spark, tmp_path):
    keys = [base + i for base in (0, 1_000_000, 2_000_000) for i in range(1, 9)]
    part = spark.createDataFrame([(k, f"p{k}") for k in keys], "p_partkey long, p_name string")
    rows = same(spark, "template_upsert", tmp_path, part=part)
    assert len(rows) == len(keys) + 6
    assert len({r[0] for r in rows}) == len(rows)


def test_a_line_without_amounts_is_looked_at_once(spark):
    texts = [("합계 1.234 원", [(1234, "comma")]), ("12:345", [(12345, "ocr_colon")]), ("5,000원 2024-01-05 12345678", [(5000, "comma"), (12345678, "bare")]), ("12 krw", []), ("9999원", [(9999, "won_suffix")]), ("floral lime", []), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", T.best_tokens(F.col("t")).alias("v")).collect()}
    assert [v if v is None else [(x.value, x.pattern) for x in v] for _, v in sorted(got.items())] == [want for _, want in texts]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(doc_id")


@pytest.mark.parametrize("name", ["row_texts", "amount_candidates", "supply_vat_synth", "candidate_merge_priority", "checksum_semi", "amount_score", "amount_select_top1", "amount_policy"])
def test_lines_are_dealt_out_by_document_once(spark, name):
    assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1


def test_sums_and_parts_of_equal_values(spark):
    rows = [("a", 100, 1), ("a", 200, 2), ("a", 300, 3), ("b", 100, 1), ("b", 200, 2), ("c", 100, 1), ("c", 100, 2), ("c", 200, 3)]
    found = spark.createDataFrame([(d, v, o, "", "", "합계" if v == 300 else "", "full_ocr") for d, v, o in rows], "doc_id string, value long, ordinal long, near_above string, near_below string, context string, source string")
    assert sorted(map(tuple, A.sums_to_others(found).collect())) == [("a", 300), ("c", 200)]
    assert sorted(map(tuple, A.partial_of_total(found).collect())) == [("a", 100), ("a", 200)]


@pytest.mark.parametrize("first_fit", [False, True])
def test_running_rows_go_on_over_batches_of_lines(spark, first_fit):
    ids = spark.range(30_000).select(F.when(F.col("id") < 24_000, "long").otherwise(F.concat(F.lit("d"), (F.col("id") % 3_000).cast("string"))).alias("doc_id"), F.col("id").cast("int").alias("line_idx"))
    y = F.when(F.col("doc_id") == "long", F.floor(F.col("line_idx") / 1000) * 40.0).otherwise(F.floor(F.col("line_idx") / 3000) * 40.0)
    lines = ids.withColumn("cx", F.lit(1.0)).withColumn("cy", y + F.col("line_idx") % 3).withColumn("h", F.lit(10.0))
    out = R.cluster_rows_running(lines, first_fit=first_fit)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.line_idx): r.row_idx for r in out.collect()}
    assert all(got["long", i] == i // 1000 for i in range(24_000))
    assert all(got[f"d{i % 3000}", i] == i // 3000 - 8 for i in range(24_000, 30_000))


@pytest.mark.parametrize("name", ["multiline_columns", "code_blocks"])
def test_pages_and_tables_are_dealt_out_as_items(spark, name):
    """Items are shuffled before they make lines, once for each place that reads lines or rows; nothing is stored."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(doc_id") == plan.count("FileScan parquet") == plan.count("lineitem.parquet") == 3


def test_pages_of_orders_are_dealt_out_as_keys(spark):
    """Orders are shuffled, once, before they make the lines of their pages."""
    plan = statements.lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.index("Generate inline") < plan.index("RepartitionByExpression")


def test_line_numbers_follow_from_items(spark):
    """Items are sorted; line numbers need no sort of lines."""
    plan = QUERIES["scan_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [doc_id") == 1


def test_numbers_that_end_their_line_and_others(spark):
    texts = [("l,S00", [(1500, "comma")]), ("합계 12,345", [(12345, "comma")]), ("1 12,345", [(12345, "comma")]), ("900,000,000", []), ("1,234:567", [(1234, "comma")]), ("SOLD", []), ("oooo", []), ("2024.1.5 1,000", [(1000, "comma")])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = [[(x.value, x.pattern) for x in r.v] for r in df.select("i", T.best_tokens(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in texts]


@pytest.mark.parametrize("name", ["label_window_amounts", "summary_pair_top1", "summary_triple_top1", "point_in_interval_cells"])
def test_amounts_labels_and_columns_meet_without_other_shuffles(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1
    assert plan.count("lineitem.parquet") == 1


def test_totals_at_the_edge_of_what_is_close(spark):
    """The largest total that is close to a sum, against all values in plain Python."""
    close = lambda a, b: abs(a - b) <= max(2500, int(max(a, b) * 0.001))
    sums = [1100, 2_499_999, 2_500_000, 9_990_000, 99_000_000, 123_456_789, 549_999_945]
    df = spark.createDataFrame([(s,) for s in sums], "s long").select("s", P._largest_close(F.col("s")).alias("most"))
    for s, most in df.collect():
        assert close(s, most) and not close(s, most + 1)
        supply = s * 10 // 11
        values = [(1, supply), (2, s - supply), (9, most), (9, most + 1), (9, s - 1)]
        got = P.summary_pairs(spark.createDataFrame([("d", r, v) for r, v in values], "doc_id string, row_idx int, value long")).first()
        assert (got.supply, got.tax, got.total, got.score) == (supply, s - supply, most, 92)


@pytest.mark.parametrize("name", ["invoice_row_tests", "line_amounts", "line_parties", "line_identifiers"])
def test_distinct_texts_are_not_gathered_in_the_driver(spark, name):
    """A hundred texts of each part look as small as the file of parts, which a join by broadcast would take at its word."""
    assert "Broadcast" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_value", "lines_in_boxes", "page_anchor_maps", "region_match", "same_row_peers", "warped_region_match"])
def test_lines_of_pages_are_not_gathered_in_the_driver(spark, name):
    assert "Broadcast" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["label_value", "representative_near"])
def test_values_meet_labels_without_another_shuffle(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("orders.parquet") == 1 and "Join" not in plan


def test_values_around_anchors_against_all_lines(spark):
    rng = random.Random(5)
    clean, valid = (lambda c: F.regexp_replace(c, "^[: ]+", "")), (lambda c: c.rlike("^[a-z]{2}"))
    lines = []
    for doc, n in (("p", 120), ("q", 40), ("r", 9)):
        for i in range(n):
            x, y, w, h = float(rng.randint(0, 900)), float(rng.randint(0, 120) * 3), 10.0, rng.choice([0.0, 4.0, 10.0, 10.0, 55.0, 300.0])
            lines.append((doc, i, x, y, x + w / 2, y + h / 2, h, rng.choice(["ab", "cd e", "7", "", "이름", "이름: ef", "anchor 1", "Z", None])))
    df = spark.createDataFrame(lines, "doc_id string, line_idx int, x double, y double, cx double, cy double, h double, text string")
    got = {(r.doc_id, r.near_idx): (r.anchor_idx, r.stage, r.line_idx, r.value) for r in spatial.value_around(df, F.col("text").startswith("anchor"), "이름", clean, valid, 800, 1000).collect()}
    value = lambda t: (v := re.sub("^[: ]+", "", t or "")) if re.match("[: ]*[a-z]{2}", t or "") else None
    want = {}
    for doc, i, _, _, cx, cy, _, text in lines:
        if not (text or "").startswith("anchor"):
            continue
        near = sorted((x for x in lines if x[0] == doc and abs(x[4] - cx) / 800 <= 0.35 and abs(x[5] - cy) / 1000 <= 0.22), key=lambda x: (x[3], x[2], x[1]))
        for at, a in enumerate(near):
            if "이름" not in (a[7] or ""):
                continue
            found = [(0, at, a[1], value(a[7].split("이름")[1]))]
            found += [(1, k, b[1], value(b[7])) for k, b in enumerate(near) if b[1] != a[1] and b[2] > a[2] and abs(a[5] - b[5]) <= max(a[6], b[6]) * 1.2]
            found += [(2, k, near[k][1], value(near[k][7])) for k in range(at + 1, min(at + 4, len(near)))]
            if found := sorted(f for f in found if f[3] is not None):
                want[doc, i] = (a[1], found[0][0], found[0][2], found[0][3])
                break
    assert got == want and {v[1] for v in want.values()} == {0, 1, 2}


@pytest.mark.parametrize("name", ["value_line_scores", "value_source_boxes"])
def test_values_meet_lines_without_another_shuffle(spark, name):
    """Orders are dealt out by document, once for lines and once for fields, or once for both; pairs are not."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning(") == plan.count("orders.parquet") <= 2


@pytest.mark.parametrize("name", ["transposed_columns", "transposed_items"])
def test_columns_find_their_heads_without_another_shuffle(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and plan.count("lineitem.parquet") == 1 and "Join" not in plan
