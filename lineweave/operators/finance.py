"""Fields of bank slips from their lines: anchors first, then the next lines, with reasons for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bank names by canonical name, transaction types in order of precedence, anchors.
BANKS = {"국민은행": r"국민은행|KB국민", "신한은행": r"신한은행|신한", "우리은행": r"우리은행", "하나은행": r"하나은행|KEB", "농협은행": r"농협"}
KINDS = {"transfer": r"이체|송금", "atm": r"자동화기기|(?i)\batm\b", "withdraw": r"출금|지급", "deposit": r"입금"}
AMOUNT_ANCHORS = (r"거래금액", r"출금액|입금액", r"이체금액|송금금액", r"금액")
BALANCE = r"거래후잔액|잔액|잔고"
ACCOUNT = r"계좌번호|계좌"
MASKED = r"\d{2,}[-\d]*[*xX]{2,}[-\d*xX]*"


def _first_amount(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"(\d[\d,]*\d{2})", 1), ",", "").try_cast("long")


def slip_fields(lines: DataFrame) -> DataFrame:
    """One row for each doc_id: bank_name, transaction_type, transaction_at, amount, balance_after, account_masked, reasons.

    Values stand on the anchor's line or on the next one. Amounts follow the first anchor group that has one and are never
    a balance; account numbers are kept only if masked. Reasons name what is missing or ambiguous.
    """
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    t = lines.select("doc_id", "line_idx", "text", F.lead("text", 1, "").over(order).alias("after"))
    bare = F.regexp_replace("text", r"\s+", "")
    is_balance = bare.rlike(BALANCE)

    def near(anchor: str, value) -> Column:
        here = F.when(bare.rlike(anchor), F.coalesce(value(F.col("text")), F.when(~F.regexp_replace("after", r"\s+", "").rlike(BALANCE), value(F.col("after")))))
        return F.when(~is_balance, here) if anchor != BALANCE else F.when(is_balance, F.coalesce(value(F.col("text")), value(F.col("after"))))

    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_idx")))
    has = lambda p: F.bool_or(bare.rlike(p))
    masked = lambda c: F.nullif(F.regexp_extract(c, f"({MASKED})", 1), F.lit(""))
    when = r"((?:19|20)\d{2})[./-](\d{1,2})[./-](\d{1,2})(?:\s+(\d{1,2}):(\d{2}))?"
    at = F.when(F.col("text").rlike(when), F.concat_ws("-", F.regexp_extract("text", when, 1), F.lpad(F.regexp_extract("text", when, 2), 2, "0"), F.lpad(F.regexp_extract("text", when, 3), 2, "0")))
    found = t.groupBy("doc_id").agg(
        F.array_compact(F.array(*(F.when(has(p), F.lit(name)) for name, p in BANKS.items()))).alias("banks"),
        F.coalesce(*(F.when(has(p), F.lit(name)) for name, p in KINDS.items())).alias("transaction_type"),
        first(at).alias("transaction_at"),
        F.coalesce(*(first(near(a, _first_amount)) for a in AMOUNT_ANCHORS)).alias("amount"),
        first(near(BALANCE, _first_amount)).alias("balance_after"),
        first(near(ACCOUNT, masked)).alias("account_masked"),
    )
    bank = F.get("banks", F.lit(0))
    missing = F.array_compact(F.array(F.when(bank.isNull(), "no_bank"), F.when(F.size("banks") > 1, "several_banks"), F.when(F.col("transaction_type").isNull(), "no_type"), F.when(F.col("transaction_at").isNull(), "no_date"), F.when(F.col("amount").isNull(), "no_amount")))
    return found.select("doc_id", bank.alias("bank_name"), "transaction_type", "transaction_at", "amount", "balance_after", "account_masked", F.array_join(missing, ",").alias("reasons"))
