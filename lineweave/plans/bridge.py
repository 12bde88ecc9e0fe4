"""Line tables derived from the star schema: an order is a receipt, its line items are rows with name, quantity and amount.

The SQL runs on Spark and DuckDB; only the thousands format differs. Every value is a function of keys, so both engines
see the same lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("orders", "lineitem", "part", "customer")


def _digits(b: str) -> str:
    weights = (1, 3, 7, 1, 3, 7, 1, 3, 5)
    total = " + ".join(f"{w} * cast(substr({b}, {i}, 1) as int)" for i, w in enumerate(weights, 1))
    return f"(10 - ({total} + cast(floor(cast(substr({b}, 9, 1) as int) * 5 / 10) as int)) % 10) % 10"


def lines_sql(engine: str) -> str:
    """SELECT of doc_id, line_idx, x, y, w, h, cx, cy, text, conf."""
    spark = engine == "spark"
    t = (lambda n: "{" + n + "}") if spark else (lambda n: n)
    fmt = (lambda x: f"format_number({x}, 0)") if spark else (lambda x: f"format('{{:,}}', {x})")
    if spark:
        return _one_pass(t, fmt)
    items = f"""    union all
    select k, 40, 200 + 30 * n, name from (select l_orderkey as k, p_name as name, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n from {t('lineitem')} join {t('part')} on l_partkey = p_partkey) q
    union all
    select k, 420, 200 + 30 * n, cast(qty as string) from (select l_orderkey as k, cast(floor(l_quantity) as bigint) as qty, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n from {t('lineitem')}) q
    union all
    select k, 620, 200 + 30 * n, {fmt('amt')} from (select l_orderkey as k, cast(floor(l_extendedprice) as bigint) as amt, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as n from {t('lineitem')}) q
    union all
    select k, 400, 240 + 30 * n, concat('공급가액 ', {fmt('s')}) from (select l_orderkey as k, sum(cast(floor(l_extendedprice) as bigint)) as s, count(*) as n from {t('lineitem')} group by l_orderkey) q
    union all
    select k, 400, 270 + 30 * n, concat('부가세 ', {fmt('cast(floor(s / 10) as bigint)')}) from (select l_orderkey as k, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as s, count(*) as n from {t('lineitem')} group by l_orderkey) q
    union all
    select k, 400, 300 + 30 * n, concat('합계 ', {fmt('s + cast(floor(s / 10) as bigint)')}) from (select l_orderkey as k, cast(sum(cast(floor(l_extendedprice) as bigint)) as bigint) as s, count(*) as n from {t('lineitem')} group by l_orderkey) q
    where k % 3 <> 0"""
    # even customers get a right check digit, odd ones a wrong one
    return f"""
select doc_id, cast(row_number() over (partition by doc_id order by y, x) - 1 as int) as line_idx, x, y,
  cast(length(text) * 9 as double) as w, cast(18 as double) as h,
  x + length(text) * 9 / 2.0 as cx, y + 9.0 as cy, text,
  cast((k * 31 + cast(y as bigint) * 7 + cast(x as bigint)) % 71 + 30 as double) / 100 as conf
from (
  select k, concat('R', cast(k as string)) as doc_id, cast(x as double) as x, cast(y0 + (k + x) % 3 as double) as y, text
  from (
    select o_orderkey as k, 40 as x, 40 as y0, c_name as text from {t('orders')} join {t('customer')} on o_custkey = c_custkey
    union all
    select k, 40, 70, concat('사업자번호 ', substr(b, 1, 3), '-', substr(b, 4, 2), '-', substr(b, 6, 4), cast(({_digits('b')} + c % 2) % 10 as string))
    from (select o_orderkey as k, o_custkey as c, cast(100000000 + (o_custkey * 7919) % 900000000 as string) as b from {t('orders')}) q
    union all
    select o_orderkey, 40, 100, concat('거래일시 ', cast(cast(o_orderdate as date) as string)) from {t('orders')}
{items}
  ) u
) v
"""


def _one_pass(t: Callable[[str], str], fmt: Callable[[str], str]) -> str:
    """The same lines for Spark: orders and items are dealt out by document once, while they are still short rows. Items are
    numbered and summed there; an item makes its three lines, the last one also those of the sums. Rows lie 30 apart and the
    three lines of an item never on one height, so line numbers follow from the numbers of items and need no sort of lines. What
    follows by document (medians, rows) finds the rows where it needs them."""
    tenth = "cast(floor(s / 10) as bigint)"
    last = lambda x: f"case when kind = 2 and i = m then {x} end"
    off = lambda x: f"(k + {x}) % 3"
    place = lambda x, *others: "first + 3 * (i - 1) + " + " + ".join(f"cast({off(o)} < {off(x)} as int)" for o in others)
    made = (
        "40", "case kind when 0 then 40 when 1 then 70 else 200 + 30 * i end", f"case when kind = 2 then {place(40, 420, 620)} else n - 1 end", "text",
        "case kind when 1 then 40 else 420 end", "case kind when 1 then 100 when 2 then 200 + 30 * i end", f"case when kind = 2 then {place(420, 40, 620)} else b + n - 1 end", "case kind when 1 then day else cast(qty as string) end",
        "620", "case when kind = 2 then 200 + 30 * i end", place(620, 40, 420), fmt("amt"),
        "400", last("240 + 30 * i"), "first + 3 * m", last(f"concat('공급가액 ', {fmt('s')})"),
        "400", last("270 + 30 * i"), "first + 3 * m + 1", last(f"concat('부가세 ', {fmt(tenth)})"),
        "400", last("case when k % 3 <> 0 then 300 + 30 * i end"), "first + 3 * m + 2", last(f"concat('합계 ', {fmt(f's + {tenth}')})"),
    )
    head = "cast(null as bigint) as qty, cast(null as bigint) as amt, cast(null as bigint) as ln, cast(null as bigint) as pk, cast(null as double) as price"
    return f"""
select doc_id, cast(idx as int) as line_idx, x, y,
  cast(length(text) * 9 as double) as w, cast(18 as double) as h,
  x + length(text) * 9 / 2.0D as cx, y + 9.0D as cy, text,
  cast((k * 31 + cast(y as bigint) * 7 + cast(x as bigint)) % 71 + 30 as double) / 100 as conf
from (
  select k, doc_id, cast(x1 as double) as x, cast(y1 + {off("x1")} as double) as y, idx, t1 as text
  from (
    select k, doc_id, text, day, qty, amt, kind, n, s, b, m, n - a - b as i, a + 2 * b as first from (
      -- a, b, m: rows of names, orders and items
      select *, row_number() over (partition by doc_id order by kind, ln, pk, price) as n, cast(sum(amt) over (partition by doc_id) as bigint) as s,
        count_if(kind = 0) over (partition by doc_id) as a, count_if(kind = 1) over (partition by doc_id) as b, count_if(kind = 2) over (partition by doc_id) as m
      from (
        select k, concat('R', cast(k as string)) as doc_id, text, day, qty, amt, ln, pk, price, kind from (
          select o_orderkey as k, c_name as text, cast(null as string) as day, {head}, 0 as kind from {t('orders')} join {t('customer')} on o_custkey = c_custkey
          union all
          select k, concat('사업자번호 ', substr(b, 1, 3), '-', substr(b, 4, 2), '-', substr(b, 6, 4), cast(({_digits('b')} + c % 2) % 10 as string)), concat('거래일시 ', cast(cast(at as date) as string)), {head}, 1
          from (select o_orderkey as k, o_custkey as c, o_orderdate as at, cast(100000000 + (o_custkey * 7919) % 900000000 as string) as b from {t('orders')}) q
          union all
          select l_orderkey, p_name, null, cast(floor(l_quantity) as bigint), cast(floor(l_extendedprice) as bigint), l_linenumber, l_partkey, l_extendedprice, 2
          from {t('lineitem')} join {t('part')} on l_partkey = p_partkey
        ) a
      ) u
    ) c
  ) r lateral view stack(6, {', '.join(made)}) as x1, y1, idx, t1
  where y1 is not null
) v
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES}
    return spark.sql(lines_sql("spark"), **tables)
