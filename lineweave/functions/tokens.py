"""Column functions on the numbers, codes and quantities of invoice lines; nulls count as empty texts, none fails.

All are built-in expressions. Functions that return several values return arrays; those that find nothing return ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lineweave.functions.text import biz_format, biz_valid, fix_digits, once, thousands, to_int

#: Unicode classes for white space, digits, word characters and their borders.
_U = "(?U)"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(text_of(c), _U + r"\s+", "")


def single_spaced(c: Column) -> Column:
    return F.btrim(F.regexp_replace(text_of(c), _U + r"\s+", " "))


def has(c: Column, pattern: str, exact_case: bool = False) -> Column:
    return c.rlike(("" if exact_case else "(?i)") + (_U if r"\b" in pattern else "") + pattern)


def whole(c: Column, pattern: str, exact_case: bool = False) -> Column:
    return c.rlike(("" if exact_case else "(?i)") + rf"^(?:{pattern})\z")


def times(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit("(?i)" + pattern))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first(values: Column) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def last(values: Column) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(-1)), F.lit(""))


def clean_value(c: Column) -> Column:
    """Marks and white space at both ends cut."""
    return F.regexp_replace(text_of(c), r"(?U)^[\s:：;|ㆍ.\-()\[\]]+|[\s:：;|ㆍ.\-()\[\]]+\z", "")


def _money(digit_texts: Column, least: int, most: int) -> Column:
    """Numbers in range, with thousands commas; eight digits that begin like a year are dates."""
    digits = F.transform(digit_texts, lambda x: F.regexp_replace(x, r"\D", ""))
    values = F.transform(F.filter(digits, lambda d: ~d.rlike(r"^(19|20)\d{6}$")), to_int)
    return F.transform(F.filter(values, lambda v: v.between(least, most)), thousands)


def amount_values(c: Column, least: int = 100) -> Column:
    """Grouped numbers and runs of four digits or more, from ``least`` to a thousand million."""
    return _money(found(fix_digits(text_of(c), "invoice"), r"(?<!\d)(?:\d{1,3}(?:[,.]\d{3})+|\d{4,})(?!\d)"), least, 1_000_000_000)


def table_money(c: Column) -> Column:
    """Grouped numbers alone."""
    return _money(found(fix_digits(text_of(c), "invoice"), r"(?<!\d)\d{1,3}(?:[,.]\d{3})+(?!\d)"), 100, 1_000_000_000)


def quantity_values(c: Column) -> Column:
    """Numbers that touch no letter, from 1 to ten million; dates count too."""
    raw = found(fix_digits(text_of(c), "invoice"), r"(?<![\dA-Za-z])(?:\d{1,3}(?:[,.]\d{3})+|\d{1,6})(?![\dA-Za-z])")
    return F.transform(F.filter(F.transform(raw, to_int), lambda v: v.between(1, 10_000_000)), thousands)


def row_numbers(c: Column) -> Column:
    """Words that are numbers, with or without currency; from four digits on with commas, dates left out."""
    words = F.split(fix_digits(text_of(c), "invoice"), _U + r"\s+")
    # a currency sign may stand apart from its number only where no white space does
    raw = F.transform(words, lambda w: F.regexp_extract(w, r"^(?:₩)?(\d{1,3}(?:[,.]\d{3})+|\d+(?:[.]\d+)?)(?:원)?\z", 1))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    kept = F.filter(raw, lambda x: (x != "") & ~digits(x).rlike(r"^(19|20)\d{6}$"))
    return F.transform(kept, lambda x: F.when(F.length(digits(x)) >= 4, F.coalesce(thousands(to_int(x)), x)).otherwise(x))


def receipt_amounts(c: Column, near_keyword: Column) -> Column:
    """The first that finds any: grouped numbers; near a keyword a cut group (35,0 is 35,000), then five to seven digits."""
    t = F.regexp_replace(fix_digits(text_of(c), "field"), r"(\d)\.(\d{3})", "$1,$2")
    in_range = lambda v, least: F.filter(v, lambda n: n.between(least, 100_000_000))
    grouped = F.filter(found(t, r"\d{1,3}(?:,\d{3})+"), lambda x: to_int(x).between(100, 100_000_000))
    filled = lambda x: to_int(F.concat(F.substring_index(x, ",", 1), F.rpad(F.substring_index(x, ",", -1), 3, "0")))
    cut = F.transform(in_range(F.transform(found(t, r"\d{1,3},\d{1,2}(?!\d)"), filled), 100), thousands)
    bare = F.transform(in_range(F.transform(found(t, r"(?<!\d)\d{5,7}(?!\d)"), to_int), 1000), thousands)
    keyword = F.coalesce(near_keyword, F.lit(False))
    near = F.when(keyword, once(cut, lambda x: F.when(F.size(x) > 0, x).otherwise(bare))).otherwise(F.array().cast("array<string>"))
    return once(grouped, lambda x: F.when(F.size(x) > 0, x).otherwise(near))


def code_or_lot(c: Column) -> Column:
    """Whether a value is a date, five to eight digits, or letters with digits, marks aside."""
    s = F.regexp_replace(fix_digits(text_of(c), "invoice"), _U + r"[\s,._/\-]+", "")
    return s.rlike(r"^(19|20)\d{6}\z") | s.rlike(r"^\d{5,8}\z") | (s.rlike("[A-Za-z]") & s.rlike(r"\d"))


# ---- tokens of free-form rows ----
def number_token(c: Column) -> Column:
    """A token without marks at its ends and currency signs."""
    return F.regexp_replace(F.btrim(single_spaced(c), F.lit("()[]{}.,:;|")), "[￦₩원]", "")


def _bare(c: Column) -> Column:
    return F.replace(number_token(c), F.lit(","), F.lit(""))


def comma_space_money(c: Column) -> Column:
    """``301, 100`` is one number."""
    return F.regexp_replace(single_spaced(c), r"(?<!\d)(-?\d{1,3}),\s+(\d{3})(?!\d)", "$1,$2")


def date_like(c: Column) -> Column:
    return _bare(c).rlike(r"^(?:(?:19|20)?\d{6}|\d{8})\z")


def lot_like(c: Column) -> Column:
    return _bare(c).rlike(r"^\d{5,}\z") & ~date_like(c)


def number_value(c: Column) -> Column:
    """The number as a double, or null."""
    t = _bare(c)
    return F.when(t.rlike(r"^-?\d+(?:\.\d+)?\z"), t.try_cast("double"))


def money_value(c: Column) -> Column:
    """The number as a double; null for dates."""
    return F.when(~date_like(c), number_value(c))


def normalise_money(c: Column) -> Column:
    t = number_token(c)
    return F.when((t == "") | t.rlike(r"^-?\d+(?:,\d{3})*(?:\.\d+)?\z"), t).otherwise(single_spaced(c))


def normalise_quantity(c: Column) -> Column:
    return F.regexp_replace(_bare(c), r"^(\d+)\.0+\z", "$1")


def normalise_spec(c: Column) -> Column:
    t = F.regexp_replace(single_spaced(c), r"\s*\*\s*", "*")
    t = F.regexp_replace(t, r"(?<=\d)\s+(?=[A-Za-z])", "")
    return F.regexp_replace(t, r"(?<=[A-Za-z])\s+(?=\()", "")


def is_money(c: Column) -> Column:
    return F.coalesce(number_value(c).isNotNull() & (number_token(c).contains(",") | (number_value(c) >= 100)), F.lit(False))


def is_quantity(c: Column) -> Column:
    t = _bare(c)
    return F.coalesce(t.rlike(r"^\d{1,4}(?:\.\d+)?\z") & (t.try_cast("double") > 0), F.lit(False))


def is_spec(c: Column) -> Column:
    t = single_spaced(c)
    return has(t, r"\d+\s*(?:T|TAB|CAP|EA|BOX|ML|MG|G|DOSE)\b") | has(t, r"\d+(?:ml|mg|g)\s*[*xX]\s*\d+") | t.rlike(r"\d+[A-Za-z|]*[*xX]\d+") | (t.rlike(r"\d") & t.rlike("[A-Za-z]") & (F.length(t) <= 20))


def token_kind(c: Column) -> Column:
    """Class of a token, by the first rule that holds: real_money, date_like, phone_like, biz_number_like,
    page_or_metadata, quantity_like, order_code, product_code, lot_or_serial, unknown. Only real_money is kept as money."""
    return once(F.btrim(single_spaced(c), F.lit("()[]{}:;|")), _kind)


def _kind(t: Column) -> Column:
    u = F.upper(t)
    return (
        F.when(t.rlike(r"^-?\d{1,3}([.,]\d{3})+\z"), "real_money")
        .when(t.rlike(r"^\d{4}/\d{2}/\d{2}\z|^\d{2}/\d{2}/\d{2}"), "date_like")
        .when(t.rlike(r"^0\d-\d{3,4}-\d{4}\z"), "phone_like")
        .when(t.rlike(r"^\d{3}-\d{2}-\d{5}\z"), "biz_number_like")
        .when(t.rlike(r"^0\d{4}\z"), "page_or_metadata")
        .when(u.rlike(r"^\d+(?:ML|MG|G|T|TAB|CAP|P|EA|BOX|DOSE)\z|\d+(?:ML|MG|M|G)[*X|]+\d+"), "quantity_like")
        .when(t.rlike("[가-힣]"), "unknown")
        .when(t.rlike("[A-Za-z]") & t.rlike(r"\d") & ~t.contains(","), F.when(t.contains("-"), "order_code").otherwise("product_code"))
        .when(t.rlike(r"^\d+-\d+\z"), "lot_or_serial")
        .when(t.rlike(r"^\d{1,3}\z"), "quantity_like")
        .when(t.rlike(r"^\d{6,}\z"), "lot_or_serial")
        .otherwise("unknown")
    )


NO_MONEY = ("product_code", "order_code", "lot_or_serial", "date_like", "biz_number_like", "phone_like", "page_or_metadata")


def money_tokens(c: Column) -> Column:
    """Numbers of a free-form row, grouped or of four digits or more, that stand in no code and are no dates, in order."""
    words = F.split(comma_space_money(c), " ")
    numbers = lambda w: F.transform(found(w, r"(?<!\d)(?:-?\d{1,3}(?:,\d{3})+|-?\d{4,})(?!\d)"), lambda x: F.struct(w.alias("word"), x.alias("x")))
    kept = F.filter(F.flatten(F.transform(words, numbers)), lambda n: ((n["word"] == n["x"]) | ~token_kind(n["word"]).isin(*NO_MONEY)) & ~date_like(n["x"]))
    return F.transform(kept, lambda n: n["x"])


def money_pair(c: Column) -> Column:
    """The last two money tokens, or an empty array where there are fewer."""
    return once(money_tokens(c), lambda tokens: F.when(F.size(tokens) >= 2, F.slice(tokens, -2, 2)).otherwise(F.array().cast("array<string>")))


def name_and_spec(c: Column) -> Column:
    """struct(name, spec): the last word apart where it is a specification, else null."""
    return once(single_spaced(c), lambda t: once(normalise_spec(F.regexp_extract(t, r"^(.+) (\S+)\z", 2)), lambda tail: _parted(F.regexp_extract(t, r"^(.+) (\S+)\z", 1), tail)))


def _parted(name: Column, tail: Column) -> Column:
    t = F.btrim(tail, F.lit("()[]{}.,:;|"))
    u = F.upper(t)
    lot = ~u.contains(",") & ~date_like(u) & u.rlike(r"^[A-Z0-9]+(?:-[A-Z0-9]+)*-\d+EA\z")
    plain_number = money_value(t).isNotNull() & ~t.rlike("[A-Za-z]")
    unit = u.rlike(r"^\d+(?:\.\d+)?(?:T|C|CAP|TAB|DOSE|ML|MI|M[I1L]|MG|NG|G|N1)\z|^\d+(?:ML|MG|G)\s*[*X]\s*\d+\z")
    good = (name != "") & (t != "") & (F.length(t) <= 20) & ~lot & ~plain_number & (unit | is_spec(t))
    return F.when(good, F.struct(name.alias("name"), tail.alias("spec")))


# ---- parts of a row's text ----
def expiry_date(c: Column) -> Column:
    """Eight digits, else yyyy-mm-dd as digits, else six digits."""
    t = text_of(c)
    month_day = r"(?:0[1-9]|1[0-2]){0}(?:0[1-9]|[12]\d|3[01])"
    long, dashed, short = (F.regexp_extract(t, rf"(?<!\d)({year}{month_day.format(sep)})(?!\d)", 1) for year, sep in ((r"20\d{2}", ""), (r"20\d{2}[-./]", "[-./]"), (r"\d{2}", "")))
    return F.when(long != "", long).when(dashed != "", F.regexp_replace(dashed, "[-./]", "")).otherwise(short)


def serial_number(c: Column) -> Column:
    return F.regexp_extract(text_of(c), r"(?i)(?<![A-Z0-9])(\d{6,}[-/]\d{6,}[-/]\d{6,})(?![A-Z0-9])", 1)


def unit_of(c: Column) -> Column:
    return F.upper(F.regexp_extract(text_of(c), r"(?i)(?<![\p{L}\p{N}_])(BOX|EA)(?![\p{L}\p{N}_])", 1))


def item_code(c: Column, item_name: Column, spec: Column) -> Column:
    """The first code of capitals and three digits or more after the name and the specification that begin the text."""
    rest = text_of(c)
    for part in (text_of(item_name), text_of(spec)):
        rest = F.when((part != "") & rest.startswith(part), F.btrim(F.substring(rest, F.length(part) + 1, F.length(rest)))).otherwise(rest)
    return F.regexp_extract(rest, r"(?U)\b((?:[A-Z]{2,6}-)?[A-Z]{1,5}\d{3,}[A-Z0-9]*)\b", 1)


def lot_number(c: Column, item_name: Column, expiry: Column) -> Column:
    """The first number of four to six digits that is no expiry date and no six-digit date; those after the name first."""
    t, name = text_of(c), text_of(item_name)
    at = F.when(name != "", F.instr(t, name)).otherwise(0)
    rest = F.when(at > 0, F.regexp_replace(F.substring(t, at + F.length(name), F.length(t)), r"^\d+", "")).otherwise(t)
    month, day = (lambda x: F.substring(x, 3, 2).cast("int")), (lambda x: F.substring(x, 5, 2).cast("int"))
    dated = lambda x: (F.length(x) == 6) & month(x).between(1, 12) & day(x).between(1, 31)
    lots = lambda s: F.filter(found(s, r"(?<!\d)\d{4,6}(?!\d)"), lambda x: (x != text_of(expiry)) & ~dated(x) & (x.cast("int") > 100))
    return once(rest, lambda r: F.coalesce(F.get(lots(r), F.lit(0)), first(lots(t))))


# ---- cells ----
def cell_amount(c: Column) -> Column:
    """Spaces after thousands commas cut, where the whole cell is such a number."""
    t = text_of(c)
    cleaned = F.btrim(F.regexp_replace(t, r"(\d),\s+(\d)", "$1,$2"))
    return F.when(t.rlike(r"^[\d,\s]+\z") & cleaned.rlike(r"^\d{1,3}(?:,\d{3})*\z"), cleaned).otherwise(t)


def cell_quantity(c: Column) -> Column:
    """A stray mark behind a quantity cut."""
    t = text_of(c)
    return F.when(t.rlike(r"^\d{1,6}(?:,\d{3})*\s+[\^<>.·•]\s*\z"), F.regexp_extract(t, r"^[\d,]+", 0)).otherwise(t)


def cell_spec(c: Column) -> Column:
    """``150m`` is ml; a bracket left open by a short cell is closed."""
    t = text_of(c)
    return F.when(t.rlike(r"^\d{1,4}[mM]\z"), F.concat(t, F.lit("l"))).when((F.length(t) <= 20) & t.rlike(r"^[^()]{1,18}\([A-Za-z0-9]{0,4}\z"), F.concat(t, F.lit(")"))).otherwise(t)


# ---- business numbers ----
_BIZ = r"[1-9]\d{2}[-\s.]?\d{2}[-\s.]?\d{5}"
#: Letters read as digits when a business number is looked for, and what may stand for its digits.
BIZ_LETTERS = ("OoQDIl|ZzSsGbTBgq", "00001112255667899")


def biz_relaxed(c: Column) -> Column:
    """The first 3-2-5 digits with marks between them, unchecked."""
    t = F.regexp_replace(fix_digits(text_of(c), "field"), r"(\d)\.(\d{3})", "$1,$2")
    return F.coalesce(biz_format(first(found(t, r"[1-9]\d{2}[-\s.]\d{2}[-\s.]\d{5}"))), F.lit(""))


def biz_invoice(c: Column) -> Column:
    """The first 3-2-5 digits of an invoice line, letters read as digits, unchecked."""
    return F.coalesce(biz_format(first(found(fix_digits(text_of(c), "invoice"), r"(?<!\d)\d{3}[-\s.]\d{2}[-\s.]\d{5}(?!\d)"))), F.lit(""))


def biz_three_pass(c: Column) -> Column:
    """The first number with a right check digit: as it stands, with letters read as digits, or of digits and letters mixed."""
    t = text_of(c)
    letters = r"[0-9OoIlZzSsGbTBgq|DQ]"
    mixed = rf"[1-9IlZzSsGbTBgq]{letters}{{2}}[\s\-.]?{letters}{{2}}[\s\-.]?{letters}{{5}}"
    valid = lambda texts: F.get(F.filter(texts, lambda x: biz_valid(x)), F.lit(0))
    passes = (valid(found(t, _BIZ)), valid(found(F.translate(t, *BIZ_LETTERS), _BIZ)), valid(F.transform(found(t, mixed), lambda x: F.translate(x, *BIZ_LETTERS))))
    return F.coalesce(*(biz_format(x) for x in passes), F.lit(""))
