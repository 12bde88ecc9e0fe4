"""Functions on invoice lines and fields: values worked out by hand, nulls, empty and long texts, empty tables."""

import pytest
from pyspark.sql import functions as F

from lineweave.functions import fields as E
from lineweave.functions import tokens as K
from lineweave.operators import row_tests as R


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(f(F.col("t")).alias("v"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (K.amount_values, "A 1,234 20260101 12 5000 1234,567", ["1,234", "5,000", "1,234"]),
        (K.amount_values, None, []),
        (K.quantity_values, "3정 4 1,200 a5 600000", ["3", "4", "1,200", "600,000"]),
        (K.row_numbers, "₩12,000 x 3 4.5 20260101 1234원", ["12,000", "3", "4.5", "1,234"]),
        (K.table_money, "1,234 5678 2.000", ["1,234", "2,000"]),
        (K.money_tokens, "OP-NA0300 1, 100 12,000 20260101 301,100", ["1,100", "12,000"]),
        (K.money_pair, "1,000", []),
        (K.normalise_spec, "20 mg * 30 (B)", "20mg*30 (B)"),
        (K.normalise_quantity, "12.00", "12"),
        (K.token_kind, "02-345-6789", "phone_like"),
        (K.token_kind, "AB-12", "order_code"),
        (K.token_kind, "12345", "unknown"),
        (K.expiry_date, "까지 2027-03-15", "20270315"),
        (K.expiry_date, "2027031", ""),
        (K.serial_number, "S 123456-654321-111111", "123456-654321-111111"),
        (K.unit_of, "10 ea", "EA"),
        (K.unit_of, "정EA", ""),
        (K.cell_amount, "301, 100", "301,100"),
        (K.cell_quantity, "360 ^", "360"),
        (K.cell_spec, "150m", "150ml"),
        (K.cell_spec, "500T(B", "500T(B)"),
        (K.biz_three_pass, "220-8I-62517", "220-81-62517"),
        (K.biz_three_pass, "123-45-00000", ""),
        (K.biz_relaxed, "123 45 67890", "123-45-67890"),
        (E.phone, "TEL:02)33-4278", "02-33-4278"),
        (E.phone, "카드번호 02-345-6789", ""),
        (E.phone, "(031) 456-7890", "031-456-7890"),
        (E.address_fragment, "주소: 서울시 강남구 역삼로 12 TEL 02-345-6789", "서울시 강남구 역삼로 12"),
        (E.address_status, "서울 강남구 역삼동 12층", "complete"),
        (E.address_status, "역삼동 12", "prefix_missing"),
        (E.address_open, "서울시 강남구 역삼로 12", True),
        (E.address_open, "", False),
        (E.representative_rejected_alone, "김나라", False),
        (E.representative_rejected_alone, "한빛약국", True),
        (E.person_like, "김나라", True),
        (E.field_key, "Business_Number", "사업자번호"),
        (E.field_key, "memo", "memo"),
        (E.value_quality, "한글값", -0.03),
        (E.value_quality, "abc", 0.004),
        (E.internal_key, "serialLotComposite", True),
    ],
)
def test_value(spark, f, text, want):
    assert values(spark, f, text) == [want]


def test_parted(spark):
    assert [tuple(x) if x else None for x in values(spark, K.name_and_spec, "비타민 500mg", "비타민 1,000", None)] == [("비타민", "500mg"), None, None]
    got = values(spark, E.normalise_company, " 주식회사 한빛 AB12345 ", None)
    assert got[0]["value"] == "주식회사 한빛" and got[0]["rules"] == ["company_trailing_code_stripped", "company_internal_space_compare", "company_jusik_spacing"]
    assert got[1]["value"] == "" and got[1]["rules"] == []
    assert values(spark, E.normalise_address, "서울특발시 강남구 역삼로12 (역삼동")[0]["value"] == "서울특별시 강남구 역삼로 12 (역삼동)"
    assert tuple(values(spark, E.company_slash_representative, "한빛상사 / 김나라")[0]) == ("한빛상사", "김나라")
    assert tuple(values(spark, E.representative_phone, "김나라(01012345678)")[0]) == ("김나라", "010-1234-5678")


def test_lot_and_code(spark):
    df = spark.createDataFrame([("비타1234 55555 260101 9876",)], "t string")
    assert df.select(K.lot_number(F.col("t"), F.lit("비타1234"), F.lit("55555")), K.item_code(F.lit("비타 AB1234 X"), F.lit("비타"), F.lit(None))).first() == ("9876", "AB1234")


def test_receipt_amounts(spark):
    df = spark.createDataFrame([("35,0 11000",), ("1,000 35,0",)], "t string")
    assert df.select(K.receipt_amounts(F.col("t"), F.lit(True)), K.receipt_amounts(F.col("t"), F.lit(None).cast("boolean"))).collect() == [(["35,000"], []), (["1,000"], ["1,000"])]


ROWS = {
    None: dict(header=True, summary=True, final_item=False),
    "품명 규격 수량": dict(header=True, bad_data=False, final_item=False),
    "합 계 1,234,000": dict(summary=True, bad_data=True, final_item=False),
    "사업자번호 123-45-67890": dict(contact=True, notice=True),
    "ABC-123": dict(code_only=True, numeric_detail=True, final_item=False),
    "비타민씨 정 500mg 3 12,000": dict(probable_name=True, name_like=True, item_name="비타민씨 정", final_item=True, item_start_score=-999),
    "비타민씨정": dict(probable_name=True, item_start_score=31, final_item=True),
    "3 크림": dict(strong_item=True),
}


def test_row_tests(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(ROWS)], "i int, text string, header string")
    got = {r["text"]: r.asDict() for r in R.tested(df).collect()}
    for text, want in ROWS.items():
        assert {k: got[text][k] for k in want} == want, text
    assert R.tested(df).columns.count("header") == 1


def test_long_and_empty(spark):
    long = spark.createDataFrame([("가나다 정 1,234 " * 20_000,)], "text string")
    row = R.tested(long).select("item_name", "final_item").first()
    assert row["item_name"] == "가나다 정"
    assert R.tested(long.limit(0)).count() == 0
    assert long.select(F.size(K.amount_values(F.col("text")))).first()[0] == 20_000
