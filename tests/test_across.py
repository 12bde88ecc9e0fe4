"""Tables that run across and tables read column by column, with values worked out by hand and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lineweave.operators import multiline, transposed

LINE = "doc_id string, line_idx int, h double, cx double, cy double, text string"
PRICES = ("consumerUnitPrice", "supplyUnitPrice", "supplyAmount")


def items(spark, *lines, prices=PRICES):
    df = spark.createDataFrame([("d", i, 16.0, float(x), float(y), t) for i, (x, y, t) in enumerate(lines)], LINE)
    return [tuple(r[2:-1]) for r in sorted(transposed.transposed_items(df, 800, 1000, prices=prices).collect(), key=lambda r: r.col)]


CODES = [(100, 300, "OP-NA01"), (200, 302, "0p nb02"), (300, 301, "3 OPNC03")]


def test_items_across_the_page(spark):
    below = [
        (105, 340, "한빛정 500mg"), (95, 330, "새봄정"), (100, 360, "A123456"), (100, 380, "12,000"), (100, 400, "7,000"), (100, 420, "5,000"), (100, 440, "1,000"), (100, 460, "30 EA"),
        (210, 340, "CECLOR"), (205, 350, "합계 9,000"), (200, 360, "품명 수량"), (200, 370, "0"), (200, 380, "9999"), (200, 390, "B1"), (250, 900, "late"), (440, 350, "too far"),
    ]
    assert items(spark, *CODES, *below) == [
        ("OP-NA01", "새봄정", "A123456", "30", "12,000", "7,000", "5,000", "OP-NA01"),
        ("OP-NB02", "CECLOR", "", "1", "9,999", "", "", "0p nb02"),
        ("OPNC03", "", "", "", "", "", "", "3 OPNC03"),
    ]
    assert items(spark, *CODES[:2], *below) == []


def test_between_two_columns_the_left_one_wins(spark):
    assert [r[1] for r in items(spark, *CODES, (150, 340, "가운데약"))] == ["가운데약", "", ""]


def test_heads_behind_the_last_code(spark):
    # half a column is 55: heads from 316.5 on, 38.5 apart at least
    more = [(400, 300, "NX-9"), (420, 300, "NY-9"), (310, 300, "NZ-9"), (500, 300, "가나"), (600, 300, "12345"), (700, 330, "NW-9")]
    assert [r[0] for r in items(spark, *CODES, *more)] == ["OP-NA01", "OP-NB02", "OPNC03", "NX-9"]
    assert [r[0] for r in items(spark, *CODES, (400, 300, "N9"))] == ["OP-NA01", "OP-NB02", "OPNC03", ""]


def test_order_codes(spark):
    cases = [("x OP-Na01 y", "OP-NA01"), ("0P NA01", "OP-NA01"), ("opnab12", "OPNAB12"), ("TOP-NA01", ""), ("OP-1A", ""), ("OP-NA", ""), (None, "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [(r.t, r.got) for r in df.select("t", transposed.order_code(F.col("t")).alias("got")).collect()] == cases


READ = "doc_id string, place int, text string"
ROW = "doc_id string, row_idx int, itemName string, itemCode string, quantity string, unitPrice string, amount string"


def greedy(texts, names):
    seen, order = set(), []
    for t in texts:
        if len(t) < 3:
            continue
        for i, n in enumerate(names):
            if i not in seen and n and (t == n or (len(t) >= 6 and t in n) or (len(n) >= 6 and n in t)):
                order.append(i)
                seen.add(i)
                break
    return order if len(order) == len(names) else []


def test_names_in_reading_order(spark):
    rng = random.Random(6)
    texts, rows, want = [], [], set()
    for d in range(90):
        names = ["".join(rng.choice("가나") for _ in range(rng.choice([2, 4, 7]))) for _ in range(rng.randint(1, 5))]
        page = [rng.choice([*names, names[0] + "정", "".join(rng.choice("가나") for _ in range(6)), "x"]) for _ in range(rng.randint(0, 25))]
        texts += [(str(d), i, t) for i, t in enumerate(page)]
        rows += [(str(d), i, n, "", "", "", "") for i, n in enumerate(names)]
        want |= {(str(d), r, s) for s, r in enumerate(greedy(page, names))}
    got = multiline.name_order(spark.createDataFrame(texts, READ), spark.createDataFrame(rows, ROW))
    assert {(r.doc_id, r.row_idx, r.seq) for r in got.collect()} == want and len(want) > 40


@pytest.mark.parametrize("n, want", [(1, ["AB123"]), (2, ["CD123", "EF123"]), (3, ["GH123", "IJ123", "KL123"]), (4, [])])
def test_code_blocks(spark, n, want):
    texts = ["AB123", "x", "CD123", "EF123", "ABCDEF", "GH123", "IJ123", "KL123", "12345"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], READ)
    got = multiline.code_block(df, spark.createDataFrame([("d", n)], "doc_id string, n int"))
    assert [r.value for r in sorted(got.collect(), key=lambda r: r.seq)] == want


def test_values_behind_labels(spark):
    sizes = spark.createDataFrame([("d", 2)], "doc_id string, n int")
    read = lambda *texts: spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], READ)
    values = lambda df: [r.value for r in sorted(df.collect(), key=lambda r: r.seq)]
    amounts = lambda *texts: values(multiline.amounts_after(read(*texts), sizes, "금액", 4))
    assert amounts("금액", "1,000", "금 액", "2,000", "x", "3,000", "4,000") == ["2,000", "3,000"]
    assert amounts("금액", "1,000") == [] and amounts("금액합계표", "1,000", "2,000") == []
    assert amounts("금액", "100", "1,000", *["x"] * 20, "2,000") == []  # beyond 16 lines
    quantities = lambda *texts: values(multiline.quantities_after(read(*texts), sizes))
    assert quantities("Qty", "3", "0", "l2", "9") == ["3", "12"]
    assert quantities("수 량", "3", "단가", "9") == ["3"]
    assert quantities("수량", "10000", "1,000") == []


def test_recovered_table(spark):
    lines = ["둘째약정", "첫째약정", "AB123", "CD456", "수량", "5", "6", "금액", "1,000", "2,000"]
    df = spark.createDataFrame([(d, i, 0.0, float(i), t) for d in "de" for i, t in enumerate(lines)], "doc_id string, line_idx int, x double, cy double, text string")
    rows = [("d", 0, "첫째약정", "", "7", None, "x"), ("d", 1, "둘째약정", "", "", None, "y"), ("e", 0, "없는약", "", "", "", ""), ("e", 1, "첫째약정", "", "", "", ""), ("f", 0, "하나", "", "", "", "")]
    got = sorted(map(tuple, multiline.recovered(df, spark.createDataFrame(rows, ROW)).collect()))
    lack = ["multiline_layout_mapping_applied", "unitPrice:source_missing:0/2"]
    assert got == [
        ("d", 0, "첫째약정", "CD456", "7", None, "x", ["itemCode"], lack),
        ("d", 1, "둘째약정", "AB123", "5", None, "y", ["itemCode", "quantity"], lack),
        ("e", 0, "없는약", "", "", "", "", [], ["multiline_layout_order_mismatch"]),
        ("e", 1, "첫째약정", "", "", "", "", [], ["multiline_layout_order_mismatch"]),
        ("f", 0, "하나", "", "", "", "", [], []),
    ]
