"""Addresses that go on: values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lineweave.operators import addresses

LINE = "doc_id string, line_idx int, x double, y double, cx double, cy double, text string"
PARTY = "doc_id string, role string, address string, x double, other_x double, other_biz string"
KINDS = [("302호(당산동4가, SK V1)", True, True), ("3층", False, False), ("역삼동 5층", True, True), ("(한빛 센터)", False, False), ("12 (한빛 센터) 앞", True, False), ("TEL 02-345-6789", False, False), ("강남구 합계", False, False), ("확인 역삼동 5층", False, True), ("주식회사 강남구 역삼동", True, False), (None, False, False), ("12,345 가나다", False, False)]


def test_kinds_of_lines(spark):
    df = spark.createDataFrame(KINDS, "t string, tail boolean, line boolean")
    assert [(r.t, r.a, r.b) for r in df.select("t", addresses.tail_fragment(F.col("t")).alias("a"), addresses.address_line(F.col("t")).alias("b")).collect()] == KINDS


@pytest.mark.parametrize(
    "behind, want, status",
    [
        ([(200, 110, "302호"), (200, 120, "역삼동 빌딩")], "서울 강남구 1 302호 역삼동 빌딩", "2"),
        ([(200, 110, "아무말"), (200, 120, "302호")], "서울 강남구 1", "0"),  # a line of another kind ends it
        ([(790, 110, "302호"), (200, 120, "303호")], "서울 강남구 1 303호", "1"),  # beside the party's side: left out
        ([(400, 110, "302호"), (200, 120, "303호")], "서울 강남구 1", "0"),  # nearer to the other party: the end
        ([(200, 210, "302호")], "서울 강남구 1", "0"),
        ([(200, 110, "번호 1234567890 강남구"), (200, 120, "302호")], "서울 강남구 1", "0"),  # the other's number
        ([(200, 110, "강남구1"), (200, 120, "302호")], "서울 강남구 1 302호", "1"),  # known already
        ([(200, 110 + i, f"{i}층 강남동") for i in range(6)], "서울 강남구 1 0층 강남동 1층 강남동 2층 강남동 3층 강남동", "4"),
        ([(200, 110, "강남구 " + "가" * 130 + "동"), (200, 120, "302호")], "서울 강남구 1 302호", "1"),  # too long together
    ],
)
def test_what_is_put_to_an_address(spark, behind, want, status):
    rows = [(200, 10, "제목"), (200, 100, "주소: 서울 강남구 1"), *behind]
    lines = spark.createDataFrame([("d", i, float(x - 50), float(y - 5), float(x), float(y), t) for i, (x, y, t) in enumerate(rows)], LINE)
    parties = spark.createDataFrame([("d", "supplier", "서울 강남구 1", 200.0, 450.0, "123-45-67890"), ("d", "buyer", "부산 어딘가", None, None, None), ("e", "buyer", None, None, None, None)], PARTY)
    got = {(r.doc_id, r.role): (r.address, r.status) for r in addresses.continued(parties, lines, 800, 1000).collect()}
    assert got == {("d", "supplier"): (want, status), ("d", "buyer"): ("부산 어딘가", "source_line_not_found"), ("e", "buyer"): ("", "no_address")}
