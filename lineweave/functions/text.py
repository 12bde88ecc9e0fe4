"""Column functions on recognised text: numbers, identifiers, phones, dates, categories, cell clean-up.

All are built-in expressions, so they stay in the JVM and work on any number of rows alike; those that take lambdas
(transform, filter, aggregate) are interpreted there, not compiled. Null in, null out, unless stated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that recognition puts for digits, by table (receipt amounts, receipt fields, invoices).
DIGIT_LETTERS = {"amount": ("OoQlI|SsBZ", "0001115582"), "field": ("OlISB", "01158"), "invoice": ("OoIlSB", "001158")}
#: Patterns of dates, times and slip numbers, whose digits are no amounts.
NOT_AMOUNTS = (
    r"(?:19|20)\d{2}\s?[./\-년]\s?\d{1,2}\s?[./\-월]\s?\d{1,2}\s?일?",
    r"(?<!\d)\d{2}\s?[./\-]\s?\d{1,2}\s?[./\-]\s?\d{1,2}(?!\d)",
    r"\d{1,2}:\d{2}(?::\d{2})?(?!\d)",
    r"(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3,}",
)
#: Number patterns in order of trust, with the group that holds the number and the least value.
NUMBER_PATTERNS = (
    ("comma", r"\d{1,3}(?:,\d{3})+", 0, 100),
    ("won_suffix", r"(?i)(\d[\d,.]*)\s*(?:원|￦|₩|KRW)", 1, 1000),
    ("ocr_colon", r"(?<!\d)\d{1,3}[:;]\d{3}(?:[:;]\d{3})*(?!\d)", 0, 100),
    ("bare", r"(?<![\d,.\-])\d{4,9}(?![\d,.\-])", 0, 1000),
)
#: What every text that holds an amount matches, where ``D`` is a digit or a letter that is read as one.
_D = f"0-9{DIGIT_LETTERS['amount'][0]}"
MAY_HOLD_AMOUNT = r"[D]{4}|[D][,.:;][D]{3}|[D,.]\s*(?:원|￦|₩|(?i:KRW))".replace("D", _D)
LARGEST_AMOUNT = 500_000_000
#: Line categories in order of precedence.
CATEGORIES = (
    ("noise_label", r"(?i)승인번호|카드번호|거래일시|매출전표|영수증|가맹|합계|총계|부가세|공급가액"),
    ("biz_number", r"[1-9]\d{2}[-\s.]\d{2}[-\s.]\d{5}"),
    ("phone", r"\(?0\d{1,2}\)?[-\s]?\d{3,4}[-\s]?\d{4}"),
    ("address", r"서울|경기|인천|부산|대구|광주|대전|울산|충북|충남|전북|전남|경북|경남|제주|강원"),
    ("date", r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{2}[-./]\d{2}[-./]\d{2}"),
    ("amount_like", r"\d{1,3}(?:,\d{3})+|\d{4,}(?:원|₩)?"),
    ("merchant_hint", r"(?i)상호|가맹점|회사명|업체명|점명|가맹점명|상점명|카페|커피|마트|편의점|식당|약국|병원|의원|치킨|버거|피자|베이커리|coffee|cafe|baguette|GS25|CU|이마트|홈플러스"),
)
BIZ_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
#: Cells that mean nothing.
MEANINGLESS = ("", "-", "n/a", "null", "none", "undefined")


def fix_digits(c: Column, table: str = "amount") -> Column:
    return F.translate(c, *DIGIT_LETTERS[table])


def clean_number(c: Column) -> Column:
    """Digits repaired, and a point before three last digits read as a thousands comma."""
    return _with_commas(fix_digits(c))


def _with_commas(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d)\.(\d{3})(?!\d)", "$1,$2")


def to_int(c: Column) -> Column:
    """The digits of a text as a long; null without digits or beyond 18 of them."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("long")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def _blanked(c: Column) -> Column:
    for p in NOT_AMOUNTS:
        c = F.regexp_replace(c, p, "¤")  # cannot bridge digits
    return c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` looks at it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


#: What a text holds if a date, a time or a slip number may stand in it; and a text that ends in its only number.
MAY_BE_NO_AMOUNT = r"[./\-년:]|\d{11}"
LONE_NUMBER = r"^[^D]*([D]{1,3}(?:,[D]{3})+)$".replace("D", _D)
_TOKENS = "array<struct<value:bigint,rank:int,pattern:string>>"


def _token(value: Column, rank: int) -> Column:
    return F.struct(value.alias("value"), F.lit(rank).alias("rank"), F.lit(NUMBER_PATTERNS[rank][0]).alias("pattern"))


def _plain(c: Column) -> Column:
    """The digits of a number as NUMBER_PATTERNS find it, as a long; letters are read as digits."""
    letters, digits = DIGIT_LETTERS["amount"]
    return F.translate(c, letters + ",.:;", digits).try_cast("long")


def _tokens(c: Column, best: Callable[[Column], Column]) -> Column:
    """``best`` of the tokens of a text; a single token is left as it is.

    Most lines hold no amount, which one look tells, and most amounts end their line as its only number with thousands commas,
    which needs no other pattern. The others are read for those patterns alone of which they hold a mark.
    """
    none = F.array().cast(_TOKENS)
    has = lambda t, *marks: reduce(lambda a, b: a | b, (F.contains(t, F.lit(m)) for m in marks))

    def tagged(t: Column, rank: int) -> Column:
        _, pattern, group, least = NUMBER_PATTERNS[rank]
        values = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), _plain)
        return F.transform(F.filter(values, lambda v: v.between(least, LARGEST_AMOUNT)), lambda v: _token(v, rank))

    def by_pattern(t: Column) -> Column:
        return F.concat(
            F.when(has(t, ","), tagged(t, 0)).otherwise(none),
            F.when(t.rlike("[원￦₩Ww]"), tagged(t, 1)).otherwise(none),
            F.when(has(c, ":", ";") & c.rlike(r"\d[:;]\d"), tagged(_blanked(c), 2)).otherwise(none),
            tagged(t, 3),
        )

    cleaned = lambda t: F.when(t.rlike(MAY_BE_NO_AMOUNT), _blanked(_with_commas(t))).otherwise(t)
    in_range = lambda v: F.when(v.between(NUMBER_PATTERNS[0][3], LARGEST_AMOUNT), F.array(_token(v, 0))).otherwise(none)
    return (
        F.when(~c.rlike(MAY_HOLD_AMOUNT), none)
        .when(c.rlike(LONE_NUMBER), once(_plain(F.regexp_extract(c, LONE_NUMBER, 1)), in_range))
        .when(c.isNotNull(), once(once(once(fix_digits(c), cleaned), by_pattern), best))
    )


def number_tokens(c: Column) -> Column:
    """array<struct(value, pattern, rank)> of amounts in a text, dates and slip numbers left out; repeats stay."""
    return F.transform(_tokens(c, lambda a: a), lambda t: F.struct(t["value"].alias("value"), t["pattern"].alias("pattern"), t["rank"].alias("rank")))


def best_tokens(c: Column) -> Column:
    """number_tokens with each value once, under its most trusted pattern, by rank and value."""
    none = F.array().cast(_TOKENS)
    # a fold names the tokens once; a filter that looks at its neighbours would find them again for each
    distinct = lambda a: F.aggregate(F.array_sort(a), none, lambda kept, t: F.when(F.try_element_at(kept, F.lit(-1))["value"] == t["value"], kept).otherwise(F.concat(kept, F.array(t))))
    return _tokens(c, lambda a: F.when(F.size(a) < 2, a).otherwise(distinct(a)))


def biz_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def biz_valid(c: Column, leading_zero: bool = False) -> Column:
    """Whether ten digits carry the right check digit; false for null."""
    d = biz_digits(c)
    digit = lambda i: F.substring(d, i + 1, 1).try_cast("int")
    total = sum((digit(i) * w for i, w in enumerate(BIZ_WEIGHTS)), F.lit(0)) + F.floor(digit(8) * 5 / 10)
    good = (F.length(d) == 10) & (F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == digit(9))
    return F.coalesce(good if leading_zero else good & (digit(0) != 0), F.lit(False))


def biz_format(c: Column) -> Column:
    d = biz_digits(c)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 5)))


def biz_extract(c: Column) -> Column:
    """The first valid business number in a text as 3-2-5 digits, or null."""
    found = F.regexp_extract_all(fix_digits(c, "field"), F.lit(r"(?<!\d)(\d{3}[-. ]?\d{2}[-. ]?\d{5})(?!\d)"), 1)
    return biz_format(F.get(F.filter(found, lambda x: biz_valid(x)), F.lit(0)))


def phone_valid(c: Column) -> Column:
    return F.coalesce(biz_digits(c).rlike(r"^0[1-9]\d{7,9}$"), F.lit(False))


def phone_format(c: Column) -> Column:
    """Digits of a phone number grouped by area code; other lengths stay as digits."""
    d = biz_digits(c)
    n = F.length(d)
    part = lambda a, b: F.substring(d, a, b)
    seoul = d.startswith("02")
    return (
        F.when(n == 8, F.concat_ws("-", part(1, 4), part(5, 4)))
        .when(seoul & (n == 9), F.concat_ws("-", part(1, 2), part(3, 3), part(6, 4)))
        .when(seoul & (n == 10), F.concat_ws("-", part(1, 2), part(3, 4), part(7, 4)))
        .when(n == 10, F.concat_ws("-", part(1, 3), part(4, 3), part(7, 4)))
        .when(n == 11, F.concat_ws("-", part(1, 3), part(4, 4), part(8, 4)))
        .otherwise(d)
    )


def date_normalise(c: Column) -> Column:
    """The first date of a text as yyyy-mm-dd, or null: year month day with marks, two-digit years (pivot 70), or eight digits."""
    long = r"((?:19|20)\d{2})\s?[./\-년]\s?(\d{1,2})\s?[./\-월]\s?(\d{1,2})"
    short = r"(?:^|[^\d])(\d{2})[./\-](\d{1,2})[./\-](\d{1,2})(?:[^\d]|$)"
    digits = r"(20\d{2})(\d{2})(\d{2})"
    part = lambda p, i, x=c: F.lpad(F.regexp_extract(x, p, i), 2, "0")
    year = F.regexp_extract(c, short, 1)
    century = F.when(year.try_cast("int") >= 70, "19").otherwise("20")
    plain = F.regexp_replace(c, r"[^0-9]", "")
    return (
        F.when(c.rlike(long), F.concat_ws("-", F.regexp_extract(c, long, 1), part(long, 2), part(long, 3)))
        .when(c.rlike(short), F.concat_ws("-", F.concat(century, year), part(short, 2), part(short, 3)))
        .when(plain.rlike(digits), F.concat_ws("-", F.regexp_extract(plain, digits, 1), part(digits, 2, plain), part(digits, 3, plain)))
    )


def category(c: Column) -> Column:
    """Category of a line: empty for null or no text, else the first pattern that matches; a blank line is other."""
    t = F.coalesce(c, F.lit(""))
    chain = F.when(t == "", "empty")
    for name, pattern in CATEGORIES:
        chain = chain.when(t.rlike(pattern), name)
    bare = F.regexp_replace(t, r"\s+", "")
    return chain.when(F.length(bare).between(2, 20) & ~bare.rlike(r"\d"), "text_candidate").otherwise("other")


def meaningless(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*MEANINGLESS)


def cell(c: Column) -> Column:
    """A table cell without zero-width characters, dashes made alike, trimmed; null becomes empty."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(plain, "[‐-―−]", "-"))


def inline(c: Column) -> Column:
    """White space collapsed and marks at the ends cut."""
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" :;|/-"))


def for_compare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s\p{Punct}]+", ""))


def shortened(c: Column, n: int) -> Column:
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n - 3), F.lit("..."))).otherwise(t)


def amounts_close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(2500), F.floor(F.greatest(a, b) * 0.001))
