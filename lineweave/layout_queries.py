"""Registered queries of rectangles, rows and columns of tables drawn on a page (functions/rects.py, operators/tables.py).

Every order draws one table; places, sizes and overrides are functions of its key. The SQL runs on Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.functions import rects
from lineweave.operators import tables
from lineweave.queries import query, read

_TABLES = "select o_orderkey as k, cast(o_orderkey % 50 as double) as ax, cast(o_orderkey % 30 as double) as ay, cast(300 + o_orderkey % 200 as double) as aw, cast(60 + o_orderkey % 90 as double) as ah, cast(o_orderkey % 70 - 10 as double) as tx, cast(o_orderkey % 61 - 10 as double) as ty, cast(o_orderkey % 450 as double) as tw, cast(o_orderkey % 23 as double) as th from {orders}"
_OVERRIDES = """select k, 0 as seq, cast(k % 5 - 1 as double) as ri, cast(null as double) as oy, cast(k % 31 as double) as oh from ({t}) t union all
  select k, 1, cast(k % 3 as double), cast(k % 120 as double), cast(null as double) from ({t}) t where k % 4 <> 0 union all
  select k, 2, cast(k % 5 - 1 as double), cast(ay + 20 as double), cast(9 as double) from ({t}) t where k % 6 = 0 union all
  select k, 3, 2.5, cast(1 as double), cast(50 as double) from ({t}) t"""
_DUCK = _TABLES.replace("{orders}", "orders")


def tables_of(spark, d):
    return spark.sql(_TABLES, orders=read(spark, d, "orders"))


def _area():
    return rects.rect(*(F.col(c) for c in ("ax", "ay", "aw", "ah")))


def _template():
    return rects.rect(*(F.col(c) for c in ("tx", "ty", "tw", "th")))


_CLAMPED = "least(greatest(ax, ax + aw - 1), greatest(ax, tx)) as cx, least(greatest(ay, ay + ah - 1), greatest(ay, ty)) as cy"
_T = f"t as ({_DUCK}), c as (select *, greatest(1, least(tw, greatest(1, ax + aw - cx))) as cw, greatest(1, least(th, greatest(1, ay + ah - cy))) as ch from (select *, {_CLAMPED} from t) q)"


@query(f"with {_T} select k, cx as x, cy as y, cw as width, ch as height, case when tx - ax < 0 then ax + (tx - ax) else ax end as nx, case when ty - ay < 0 then ay + (ty - ay) else ay end as ny, abs(tx - ax) as nw, abs(ty - ay) as nh from c")
def rect_geometry(spark, d):
    t = tables_of(spark, d).withColumn("c", rects.clamped(_template(), _area()))
    n = rects.normalised(F.col("ax"), F.col("ay"), F.col("tx") - F.col("ax"), F.col("ty") - F.col("ay"))
    return t.withColumn("n", n).select("k", "c.*", F.col("n.x").alias("nx"), F.col("n.y").alias("ny"), F.col("n.width").alias("nw"), F.col("n.height").alias("nh"))


_SHARES = "case k % 5 when 0 then null when 1 then [0.5, 0.3] when 2 then [2.0, 1.0, 1.0] when 3 then [0.0, cast('nan' as double), 1.0, 7.0] else [-1.0, 4.0, 3.0] end"


@query(
    f"with t as ({_DUCK}), s as (select *, cast(2 + k % 2 as int) as parts, {_SHARES} as given from t), "
    "r as (select *, case when len(coalesce(given[1:parts], [])) = parts then list_transform(given[1:parts], lambda v: case when isfinite(v) then greatest(0.0001, v) else 0.0001 end) else list_transform(range(parts), lambda i: 1.0 / parts) end as raw from s), "
    "q as (select *, case when len(coalesce(given[1:parts], [])) = parts then list_transform(raw, lambda v: v / list_sum(raw)) else raw end as shares from r), "
    "e as (select *, unnest(range(parts)) as i from q), b as (select *, case when i = 0 then 0.0 else list_sum(shares[1:i]) end as start from e) "
    "select k, cast(i as int) as index, cast(floor(ax + aw * start + 0.5) as int) as x, cast(floor(ay + 0.5) as int) as y, cast(floor(case when i = parts - 1 then aw * (1 - start) else aw * shares[i + 1] end + 0.5) as int) as width, cast(floor(ah + 0.5) as int) as height from b"
)
def sub_regions(spark, d):
    k = F.col("k")
    array = lambda *v: F.array(*(F.lit(x) for x in v))
    given = F.when(k % 5 == 0, None).when(k % 5 == 1, array(0.5, 0.3)).when(k % 5 == 2, array(2.0, 1.0, 1.0)).when(k % 5 == 3, array(0.0, float("nan"), 1.0, 7.0)).otherwise(array(-1.0, 4.0, 3.0))
    parts = tables_of(spark, d).withColumn("given", given).withColumn("parts", (2 + k % 2).cast("int"))
    return parts.select("k", F.explode(rects.sub_regions(_area(), F.col("parts"), F.col("given"))).alias("s")).select("k", "s.*")


@query(f"with {_T} select k, cast(i as int) as row_idx, cx as x, cy + i * ch as y, cw as width, ch as height from (select *, unnest(range(least(5001, cast(floor((ay + ah - cy) / ch) as int)))) as i from c) r")
def fixed_pitch_rows(spark, d):
    t = tables_of(spark, d).select("k", F.posexplode(rects.fixed_rows(_area(), _template())).alias("row_idx", "r"))
    return t.select("k", "row_idx", "r.*")


@query(
    f"with {_T}, o as ({_OVERRIDES.format(t=_DUCK)}), base as (select k, ax, ay, aw, ah, i, cx as x, cy + i * ch as y, cw as width, ch as height from (select *, unnest(range(least(5001, cast(floor((ay + ah - cy) / ch) as int)))) as i from c) r), "
    "own as (select * from o qualify row_number() over (partition by k, ri order by seq desc) = 1), "
    "m as (select b.*, oy, case when oh >= 4 then oh else height end as h from base b left join own on own.k = b.k and own.ri = b.i), "
    "s as (select *, count(oy) over (partition by k order by i) as part from m), "
    "p as (select *, coalesce(first_value(oy) over w, first_value(y) over w) + coalesce(sum(h) over (partition by k, part order by i rows between unbounded preceding and 1 preceding), 0) as top from s window w as (partition by k, part order by i)), "
    "z as (select *, greatest(top, ay) as t2, least(h, ay + ah - greatest(top, ay)) as h2, least(greatest(ax, ax + aw - 1), greatest(ax, x)) as x2 from p where top < ay + ah) "
    "select k, cast(row_number() over (partition by k order by i) - 1 as int) as row_idx, x2 as x, t2 as y, greatest(1, least(width, greatest(1, ax + aw - x2))) as width, h2 as height from z where h2 >= 4"
)
def overridden_table_rows(spark, d):
    t = tables_of(spark, d)
    flat = spark.sql(_OVERRIDES.replace("({t})", "{base}"), base=t)
    own = flat.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("ri").alias("rowIndex"), F.col("oy").alias("y"), F.col("oh").alias("height")))), lambda o: F.struct(o["rowIndex"].alias("rowIndex"), o["y"].alias("y"), o["height"].alias("height"))).alias("overrides"))
    rows = t.join(own, "k").select("k", F.posexplode(rects.overridden_rows(rects.fixed_rows(_area(), _template()), F.col("overrides"), _area())).alias("row_idx", "r"))
    return rows.select("k", "row_idx", "r.*")


_GUIDES = "array(0.5, cast(k % 100 as double) / 100, cast(k % 7 as double) / 5, 0.25, cast(k % 37 as double) / 37 + 0.001, 0.251, 1.0, 0.0)"


@query(
    f"with t as ({_DUCK}), g as (select k, list_sort(list_filter([0.5, cast(k % 100 as double) / 100, cast(k % 7 as double) / 5, 0.25, cast(k % 37 as double) / 37 + 0.001, 0.251, 1.0, 0.0], lambda v: v > 0 and v < 1)) as s from t), "
    "f as (select k, list_reduce(list_transform(s, lambda v: [v]), lambda kept, v: case when abs(kept[-1] - v[1]) > 0.002 then list_concat(kept, v) else kept end)[1:40] as kept from g) "
    "select k, cast(i - 1 as int) as place, kept[i] as guide from (select *, unnest(range(1, len(kept) + 1)) as i from f) u"
)
def column_guides(spark, d):
    given = F.expr(_GUIDES)
    return tables_of(spark, d).select("k", F.posexplode(rects.guides(given)).alias("place", "guide"))


# ---- columns ----
_KEYS = ("itemName", "spec", "rowIndex", "quantity", "unitPrice", "remark", "amount")
_EXPECTED = " union all ".join(f"select k as doc_id, '{key}' as key, {i} as place, {'(k + ' + str(i) + ') % 3 <> 0' if i != 5 else 'false'} as required from ({{t}}) t" for i, key in enumerate(_KEYS))
_MATCHED = " union all ".join(f"select k as doc_id, '{key}' as key, ax + {60 * i} + k % 17 as x, cast({20 + 3 * i} as double) as w, ax + {60 * i} + k % 17 + {20 + 3 * i} / 2.0 as cx from ({{t}}) t where (k * {i + 3} + k // 7) % 4 < 2" for i, key in enumerate(_KEYS))


@query(
    f"with t as ({_DUCK}), e as ({_EXPECTED.format(t=_DUCK)}), m as ({_MATCHED.format(t=_DUCK)}), "
    "c as (select e.*, m.x as xl, m.cx as mcx, m.x + m.w as xr, ax as x_min, ax + aw as x_max from e left join m using (doc_id, key) join t on t.k = e.doc_id), "
    "n as (select *, count(mcx) over (partition by doc_id) as n_found, count(*) filter (required) over (partition by doc_id) as n_required, count(*) filter (required and mcx is null) over (partition by doc_id) as n_more from c), "
    "u as (select *, greatest(n_found + n_more, 1) as used, (x_max - x_min) / greatest(n_found + n_more, 1) * 0.4 as half from n where n_found >= case when n_required >= 3 then 1 else 2 end), "
    "p as (select u.*, b.place as bp, b.xl as bxl, b.mcx as bcx, a.place as ap, a.mcx as acx, a.xr as axr from u left join lateral (select * from u x where x.doc_id = u.doc_id and x.mcx is not null and x.place < u.place order by x.place desc limit 1) b on true "
    "left join lateral (select * from u x where x.doc_id = u.doc_id and x.mcx is not null and x.place > u.place order by x.place limit 1) a on true where u.mcx is not null or u.required), "
    "h as (select *, coalesce(mcx, case when bp is null then greatest(x_min + (axr - x_min) / used * 0.5, acx - (axr - x_min) / used * (ap - place + 1)) when ap is null then least(x_max - (x_max - bxl) / greatest(used - bp, 1) * 0.5, bcx + (x_max - bxl) / greatest(used - bp, 1) * (place - bp)) else bcx + (place - bp) / greatest(ap - bp, 1) * (acx - bcx) end) as cx from p), "
    "s as (select *, coalesce(xl, cx - half) as l, coalesce(xr, cx + half) as r from h), "
    "w as (select *, lag(r) over o as pr, lag(cx) over o as pc, lead(l) over o as nl, lead(cx) over o as nc, count(*) over (partition by doc_id) as cnt from s window o as (partition by doc_id order by place)) "
    "select doc_id, key, round(case when pr is null then x_min when (pr + l) / 2 <= pc then (pc + cx) / 2 else (pr + l) / 2 end, 5) as x_start, round(case when nl is null then x_max when (r + nl) / 2 >= nc then (cx + nc) / 2 else (r + nl) / 2 end, 5) as x_end, round(cx, 5) as header_cx, "
    "case when mcx is null then 'interpolated_expected' else 'expected_header' end as source, key = 'rowIndex' as display_only from w where cnt >= 2"
)
def expected_boundaries(spark, d):
    t = tables_of(spark, d)
    made = lambda sql: spark.sql(sql.replace("({t})", "{base}").replace("k // 7", "cast(floor(k / 7) as bigint)"), base=t)
    bounds = tables.expected_boundaries(made(_EXPECTED), made(_MATCHED), t.select(F.col("k").alias("doc_id"), F.col("ax").alias("x_min"), (F.col("ax") + F.col("aw")).alias("x_max")), allow_single=True)
    return bounds.select("doc_id", "key", *(F.round(c, 5).alias(c) for c in ("x_start", "x_end", "header_cx")), "source", "display_only")


@query(
    f"with t as ({_DUCK}), g as (select k, ax as lo, ax + aw as hi, cast(1 + k % 6 as int) as n, ['itemName', 'rowIndex', 'quantity', 'unitPrice', 'amount', 'remark'][1 : 1 + k % 6] as keys, list_sort(list_filter([ax + 40, ax + k % 90, ax + 200, ax - 5, ax + 120 + k % 13][1 : k % 7], lambda v: v between ax and ax + aw)) as inner_ from t), "
    "f as (select *, list_reduce(list_prepend(list_concat([lo], inner_[1 : n - 1], [hi]), list_transform(range(n), lambda i: cast([] as double[]))), lambda e, x: case when len(e) > n then e else list_concat(e[1 : list_max(list_transform(range(1, len(e)), lambda i: {'g': e[i + 1] - e[i], 'i': i})).i], [(e[list_max(list_transform(range(1, len(e)), lambda i: {'g': e[i + 1] - e[i], 'i': i})).i] + e[list_max(list_transform(range(1, len(e)), lambda i: {'g': e[i + 1] - e[i], 'i': i})).i + 1]) / 2], e[list_max(list_transform(range(1, len(e)), lambda i: {'g': e[i + 1] - e[i], 'i': i})).i + 1 :]) end) as filled from g), "
    "d as (select *, case when len(inner_) > 0 then filled else list_transform(range(n + 1), lambda i: lo + i * ((hi - lo) / n)) end as e, case when len(inner_) = n - 1 then null when len(inner_) >= n then 'too_many:' || len(inner_) || 'vs' || (n - 1) when len(inner_) > 0 then 'fewer:' || len(inner_) || 'vs' || (n - 1) else 'no_guides_even_split' end as mismatch from f) "
    "select k as doc_id, keys[i] as key, round(e[i], 5) as x_start, round(e[i + 1], 5) as x_end, round((e[i] + e[i + 1]) / 2, 5) as header_cx, keys[i] = 'rowIndex' as display_only, mismatch from (select *, unnest(range(1, n + 1)) as i from d) u"
)
def guide_boundaries(spark, d):
    keys = F.slice(F.array(*(F.lit(x) for x in ("itemName", "rowIndex", "quantity", "unitPrice", "amount", "remark"))), F.lit(1), (1 + F.col("k") % 6).cast("int"))
    inner = F.slice(F.expr("array(ax + 40, ax + k % 90, ax + 200, ax - 5, ax + 120 + k % 13)"), F.lit(1), (F.col("k") % 7).cast("int"))
    t = tables_of(spark, d).select(F.col("k").alias("doc_id"), F.col("ax").alias("x_min"), (F.col("ax") + F.col("aw")).alias("x_max"), inner.alias("guides"), keys.alias("keys"))
    bounds = tables.guide_boundaries(t)
    return bounds.select("doc_id", "key", *(F.round(c, 5).alias(c) for c in ("x_start", "x_end", "header_cx")), "display_only", "mismatch")
