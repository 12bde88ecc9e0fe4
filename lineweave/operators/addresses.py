"""Addresses that go on in the next lines of a page: a short look ahead that stops by what it has read.

The line that an address stands on and the few behind it are found by joins; only these are folded, in order, since each
line counts or not by the address as it is by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.functions import patterns as P
from lineweave.functions import tokens as K
from lineweave.functions.text import fix_digits
from lineweave.operators import row_tests

#: Lines that are looked at, letters of an address at most and of its beginning that is searched, shares of the page.
LINES, MOST_LETTERS, BEGINNING = 4, 130, 8
ZONE, LEFT, RIGHT, NEARER, DOWN = 0.42, 0.25, 0.75, 0.04, 0.10


def _no_text_of_another_kind(v: Column) -> Column:
    return ~fix_digits(v, "invoice").rlike(row_tests._BIZ) & ~v.rlike(row_tests._PHONE) & ~K.has(v, P.SUMMARY) & ~v.rlike(P.HEADER_WEAK) & ~row_tests.product_hint(v)


def tail_fragment(c: Column) -> Column:
    """Whether a line looks like the rest of an address: a word of addresses, a floor or number, or a building in brackets."""
    v = K.clean_value(c)
    some = v.rlike(P.ADDRESS_WORD) | v.rlike(r"\d+\s*(?:층|호|번지)") | v.rlike(r"\([가-힣A-Za-z0-9\s]{2,20}\)")
    return (F.length(K.squeezed(v)) >= 3) & _no_text_of_another_kind(v) & ~v.rlike(P.NO_ADDRESS_TAIL) & some


def address_line(c: Column) -> Column:
    """Whether a line could be an address of its own."""
    v = K.clean_value(c)
    s, word = K.squeezed(v), v.rlike(P.ADDRESS_WORD)
    return (F.length(s) >= 5) & _no_text_of_another_kind(v) & ~v.rlike(P.COMPANY) & ~v.rlike(P.REPRESENTATIVE_ANCHOR) & ((F.size(K.amount_values(v)) == 0) | word) & (word | s.rlike(r"\d+\s*\([가-힣]{1,12}동\)"))


def continued(parties: DataFrame, lines: DataFrame, width: float, height: float) -> DataFrame:
    """Addresses of parties with the parts of them that stand in the lines behind.

    ``parties``: doc_id, role (supplier or buyer), address, x (of the party's number, null if not found), other_x, other_biz (the
    other party's); ``lines``: doc_id, line_idx, x, y, cx, cy, text. The address is looked for by its first letters, down the page and
    across; of the next ``LINES`` lines those of the party's side that look like the rest of an address are put to it. A line
    nearer to the other party, too far down, with the other's number, or of another kind ends the search.

    Returns ``parties``'s doc_id, role, the address and ``status`` (no_address, source_line_not_found, or the number of lines put to it).
    """
    place = Window.partitionBy("doc_id").orderBy("y", "x", "line_idx")
    ordered = lines.select("doc_id", "cx", "cy", K.clean_value(F.col("text")).alias("t"), F.row_number().over(place).alias("place")).withColumn("s", K.squeezed(F.col("t")))
    asked = parties.where(K.text_of(F.col("address")) != "").withColumn("begin", F.substring(K.squeezed(F.col("address")), 1, BEGINNING))
    at = asked.join(ordered.select("doc_id", "place", F.col("cy").alias("own_cy"), "s"), "doc_id").where(F.contains("s", "begin"))
    source = at.groupBy("doc_id", "role").agg(F.min_by(F.struct("place", "own_cy"), "place").alias("at"))
    own_x = F.coalesce("x", F.when(F.col("role") == "buyer", width * LEFT).otherwise(width * RIGHT))
    found = asked.join(source, ["doc_id", "role"]).withColumn("own_x", own_x).withColumn("place", F.explode(F.transform(F.sequence(F.lit(1), F.lit(LINES)), lambda i: F.col("at.place") + i)))
    behind = found.join(ordered, ["doc_id", "place"])
    away = F.abs(F.col("cx") - F.col("other_x")) < F.abs(F.col("cx") - F.col("own_x")) - width * NEARER
    number = F.regexp_replace(K.text_of(F.col("other_biz")), "-", "")
    step = (
        F.when(~F.col("cx").between(F.col("own_x") - width * ZONE, F.col("own_x") + width * ZONE), "skip")
        .when(away | (F.abs(F.col("cy") - F.col("at.own_cy")) > height * DOWN) | (number != "") & F.contains(F.regexp_replace("t", "[^0-9]", ""), number), "stop")
        .when(tail_fragment(F.col("t")), "tail").when(address_line(F.col("t")), "other").otherwise("end")
    )
    steps = behind.groupBy("doc_id", "role").agg(F.sort_array(F.collect_list(F.struct("place", step.alias("step"), "t", "s"))).alias("steps"))
    every = parties.join(steps, ["doc_id", "role"], "left").join(source.select("doc_id", "role", F.lit(True).alias("found")), ["doc_id", "role"], "left")

    def read(state: Column, line: Column) -> Column:
        known = F.contains(F.regexp_replace(state["address"], r"(?U)\s+", ""), F.substring(line["s"], 1, BEGINNING))
        longer = K.clean_value(F.concat_ws(" ", state["address"], line["t"]))
        fits = F.length(F.regexp_replace(longer, r"(?U)\s+", "")) <= MOST_LETTERS
        keep = lambda done: F.struct(state["address"].alias("address"), F.lit(done).alias("done"), state["n"].alias("n"))
        keep_if_other = F.when(line["step"] == "end", keep(True)).otherwise(keep(False))
        more = F.struct(longer.alias("address"), F.lit(False).alias("done"), (state["n"] + 1).alias("n"))
        return F.when(state["done"], state).when(line["step"] == "skip", keep(False)).when(line["step"] == "stop", keep(True)).when(known, keep(False)).when(line["step"] == "tail", F.when(fits, more).otherwise(keep(False))).otherwise(keep_if_other)

    start = F.struct(K.text_of(F.col("address")).alias("address"), F.lit(False).alias("done"), F.lit(0).alias("n"))
    empty = F.array().cast("array<struct<place: int, step: string, t: string, s: string>>")
    out = every.withColumn("r", F.aggregate(F.coalesce("steps", empty), start, read))
    status = F.when(K.text_of(F.col("address")) == "", "no_address").when(F.col("found").isNull(), "source_line_not_found").otherwise(F.col("r.n").cast("string"))
    return out.select("doc_id", "role", F.col("r.address").alias("address"), status.alias("status"))
