"""Scores of address and company candidates as sums over pattern matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make an address or a company.
ADDRESS_TOKENS = r"[가-힣]+(?:특별시|광역시|시|도|구|군|읍|면|동|로|길)(?=\s|\d|$)"
ADDRESS_NOISE = r"승인|카드|합계|거래|금액"
COMPANY_HINT = r"주식회사|\(주\)|㈜|상사|약국|마트|식당"


def address_tokens(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(ADDRESS_TOKENS)), F.lit(0))


def address_score(c: Column, labelled: Column, y_ratio: Column) -> Column:
    """8 for each token, 12 for a label, up to 8 for standing high, less for noise, short and long texts."""
    n = F.length(F.regexp_replace(c, r"\s+", ""))
    score = 8 * address_tokens(c) + F.when(labelled, 12).otherwise(0) + 8 * (1 - y_ratio) - F.when(n < 8, 8).when(n > 60, 10).otherwise(0) - 10 * F.regexp_count(c, F.lit(ADDRESS_NOISE))
    return F.bround(score.cast("double"), 4)


def company_score(c: Column, y_ratio: Column) -> Column:
    """22 times the share of Hangul, 8 for standing high, 14 for a company word, -12 for digits."""
    n = F.greatest(F.length(F.regexp_replace(c, r"\s+", "")), F.lit(1))
    hangul = F.length(F.regexp_replace(c, "[^가-힣]", "")) / n
    return F.bround(22 * hangul + 8 * (1 - y_ratio) + F.when(c.rlike(COMPANY_HINT), 14).otherwise(0) - F.when(c.rlike(r"\d"), 12).otherwise(0), 4)
