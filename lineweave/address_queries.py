"""Registered query of addresses that go on in the next lines (operators/addresses.py).

Every order is a page with two parties; ``kind`` tells what a line was made as, which only the SQL looks at.
"""

from __future__ import annotations

from lineweave import field_queries as S
from lineweave.operators import addresses
from lineweave.queries import query, read

_W, _H = 800.0, 1000.0
_PARTS = [
    "select o_orderkey as k, 'supplier' as role, 200 as cx, 100 as cy, concat('서울 강남구 테헤란로 ', cast(o_orderkey % 90 + 10 as string)) as text, 'own' as kind from {orders} where o_orderkey % 9 <> 0",
    "select o_orderkey, 'buyer', 600, 104, concat('부산 남구 수영로 ', cast(o_orderkey % 90 + 10 as string)), 'own' from {orders}",
    "select o_orderkey, 'supplier', 200, 116, case o_orderkey % 5 when 0 then '302호 (한빛 센터)' when 1 then '3층' when 2 then 'TEL 02-345-6789' when 3 then '비고 없음' else '302호' end, case o_orderkey % 5 when 0 then 'tail' when 1 then 'short' when 2 then 'end' when 3 then 'end' else 'tail' end from {orders}",
    "select o_orderkey, 'buyer', 610, 120, case o_orderkey % 4 when 0 then '서울 강남구 테헤란로' when 1 then '대연동 77번지' when 2 then '확인 대연동 101호' else '주식회사 새봄 회사' end, case o_orderkey % 4 when 0 then 'tail' when 1 then 'tail' when 2 then 'other' else 'end' end from {orders}",
    "select o_orderkey, 'supplier', 205, 134, '판교동 (새봄 빌딩)', 'tail' from {orders} where o_orderkey % 2 = 0",
    "select o_orderkey, 'buyer', 590, 138 + o_orderkey % 80, '역삼동 5층', 'tail' from {orders} where o_orderkey % 3 <> 0",
]
_LINES = f"select k, role, cast(cx as double) as cx, cast(cy as double) as cy, cast(cx - 60 as double) as x, cast(cy - 8 as double) as y, text, kind, cast(row_number() over (partition by k order by cy, cx) - 1 as int) as line_idx from ({' union all '.join(_PARTS)}) u"
_PARTIES = """select o_orderkey as doc_id, 'supplier' as role, concat('서울 강남구  테헤란로 ', cast(o_orderkey % 90 + 10 as string)) as address, case when o_orderkey % 2 = 0 then cast(180 as double) end as x, cast(620 as double) as other_x, '123-45-67890' as other_biz from {orders}
  union all select o_orderkey, 'buyer', case when o_orderkey % 13 = 0 then '' else concat('부산 남구 수영로 ', cast(o_orderkey % 90 + 10 as string)) end, 620, case when o_orderkey % 2 = 0 then cast(180 as double) end, cast(null as string) from {orders}"""
_D = f"l as ({_LINES}), p as ({_PARTIES})".replace("{orders}", "orders")


@query(
    rf"""with {_D}, o as (select k as doc_id, cx, cy, {S._clean('text')} as t, {S._squeezed(S._clean('text'))} as s, kind, row_number() over (partition by k order by y, x, line_idx) as place from l
), a as (select *, substr({S._squeezed('address')}, 1, 8) as beginning, coalesce(x, case when role = 'buyer' then {_W} * 0.25 else {_W} * 0.75 end) as own_x from p where address <> ''
), f as (select a.*, o.place as own_place, o.cy as own_cy from a join o on o.doc_id = a.doc_id and contains(o.s, a.beginning) qualify row_number() over (partition by a.doc_id, a.role order by o.place) = 1
), st as (
  select f.doc_id, f.role, f.address, list({{'a': '', 'done': false, 'n': 0, 't': o.t, 's': o.s, 'step': case when not o.cx between own_x - {_W} * 0.42 and own_x + {_W} * 0.42 then 'skip'
      when coalesce(abs(o.cx - other_x) < abs(o.cx - own_x) - {_W} * 0.04, false) or abs(o.cy - own_cy) > {_H} * 0.1 or coalesce(contains(regexp_replace(o.t, '[^0-9]', '', 'g'), nullif(replace(other_biz, '-', ''), '')), false) then 'stop'
      when kind in ('own', 'tail') then 'tail' when kind = 'other' then 'other' else 'end' end}} order by o.place) as steps
  from f join o on o.doc_id = f.doc_id and o.place between own_place + 1 and own_place + 4 group by f.doc_id, f.role, f.address
), r as (
  select doc_id, role, list_reduce(list_prepend({{'a': address, 'done': false, 'n': 0, 't': '', 's': '', 'step': ''}}, steps), lambda z, i: case when z.done or i.step = 'skip' then z when i.step = 'stop' then {{'a': z.a, 'done': true, 'n': z.n, 't': '', 's': '', 'step': ''}}
      when contains({S._squeezed('z.a')}, substr(i.s, 1, 8)) then z when i.step = 'tail' then case when length({S._squeezed('z.a')}) + length(i.s) <= 130 then {{'a': {S._clean("z.a || ' ' || i.t")}, 'done': false, 'n': z.n + 1, 't': '', 's': '', 'step': ''}} else z end
      when i.step = 'end' then {{'a': z.a, 'done': true, 'n': z.n, 't': '', 's': '', 'step': ''}} else z end) as z from st
)
select p.doc_id, p.role, coalesce(z.a, p.address) as address, case when p.address = '' then 'no_address' when f.doc_id is null then 'source_line_not_found' else cast(coalesce(z.n, 0) as varchar) end as status from p left join f on f.doc_id = p.doc_id and f.role = p.role left join r on r.doc_id = p.doc_id and r.role = p.role"""
)
def continued_addresses(spark, d):
    orders = read(spark, d, "orders")
    lines = spark.sql(_LINES, orders=orders).withColumnRenamed("k", "doc_id").drop("role", "kind")
    return addresses.continued(spark.sql(_PARTIES, orders=orders), lines, _W, _H)
