"""Registered queries of the document operators, each with its SQL for DuckDB.

The driver's tables hold no receipts, so most queries run on lines derived from orders and their items (plans/bridge.py);
others use documents, events, conversations, customers, suppliers, labels and benchmark directly. All read whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.functions import text as T
from lineweave.operators import amounts, evaluate, export, history, parties, restore, rows, tables
from lineweave.plans import bridge
from lineweave.sources import json as sources
from lineweave.sources.shared import stored
from lineweave.streaming import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    return bridge.lines(spark, d)


def clustered_of(spark: SparkSession, d: str) -> DataFrame:
    """Clustered lines, dealt out by document; what is made of them by document needs no other shuffle."""
    return rows.cluster_rows(rows.confident(lines_of(spark, d)))


def near_of(clustered: DataFrame) -> DataFrame:
    return rows.neighbours(rows.row_texts(clustered))


# ---- shared SQL: each part is a list of common table expressions ----
LINES = f"lines as ({bridge.lines_sql('duckdb')})"
OK = LINES + ", ok as (select * from lines where conf >= 0.3 and w >= 5 and h >= 5)"
ROWED = (
    OK
    + """, med as (
  select doc_id, list_sort(list(w))[cast(floor(count(*) / 2) as int) + 1] as mw, list_sort(list(h))[cast(floor(count(*) / 2) as int) + 1] as mh from ok group by doc_id
), sized as (
  select ok.*, case when mh > greatest(mw * 1.8, 80) then cx else cy end as main, case when mh > greatest(mw * 1.8, 80) then cy else cx end as side,
    greatest(case when mh > greatest(mw * 1.8, 80) then mw * 0.45 else mh * 0.75 end, 8) as gap
  from ok join med using (doc_id)
), flagged as (
  select *, case when abs(main - lag(main) over (partition by doc_id order by main, line_idx)) > gap then 1 else 0 end as fresh from sized
), rowed as (
  select *, cast(sum(fresh) over (partition by doc_id order by main, line_idx rows unbounded preceding) as int) as row_idx from flagged
)"""
)
TEXTS = ROWED + ", texts as (select doc_id, row_idx, string_agg(text, ' ' order by side, line_idx) as row_text, avg(cy) as row_cy from rowed group by doc_id, row_idx)"
NEAR = (
    TEXTS
    + r""", lean as (select *, lower(regexp_replace(row_text, '\s+', '', 'g')) as context from texts
), near as (
  select *, coalesce(lag(context) over (partition by doc_id order by row_idx), '') as near_above, coalesce(lead(context) over (partition by doc_id order by row_idx), '') as near_below,
    cast(row_idx as double) / greatest(count(*) over (partition by doc_id) - 1, 1) as row_pos
  from lean
)"""
)
TOKENS = (
    NEAR
    + r""", fixed as (select doc_id, row_idx, line_idx, text, conf, translate(text, 'OoQlI|SsBZ', '0001115582') as t from rowed
), tokens as (
  select doc_id, row_idx, text, conf, 'comma' as pattern, cast(replace(unnest(regexp_extract_all(t, '\d{1,3}(?:,\d{3})+')), ',', '') as bigint) as value, line_idx * 100 as ordinal from fixed
  union all
  select doc_id, row_idx, text, conf, 'bare', cast(unnest(regexp_extract_all(t, '(?:^|[^\d,.\-])(\d{4,9})(?:$|[^\d,.\-])', 1)) as bigint), line_idx * 100 from fixed
), amounts as (
  select * from tokens where value between 100 and 500000000 and (pattern = 'comma' or value >= 1000)
), cand as (
  select doc_id, value, pattern, row_idx, row_pos, text, conf, context, near_above, near_below, 'full_ocr' as source, ordinal from amounts join near using (doc_id, row_idx)
  union all
  select doc_id, value, pattern, row_idx, row_pos, text, conf * 0.9, context, near_above, near_below, 'amount_block', ordinal from amounts join near using (doc_id, row_idx) where row_pos >= 0.6
)"""
)
_TOTAL = "합계"
SYNTH = (
    TOKENS
    + f""", full_cand as (select * from cand where source = 'full_ocr'), pairs as (
  select a.doc_id, a.value + b.value as value, a.value - b.value as less, greatest(a.row_idx, b.row_idx) as row_idx, greatest(a.row_pos, b.row_pos) as row_pos,
    a.value || ' + ' || b.value as text, least(a.conf, b.conf) as conf,
    a.context || ' ' || a.near_above || ' ' || a.near_below as near_above, b.context || ' ' || b.near_above || ' ' || b.near_below as near_below, a.ordinal, b.ordinal as second
  from full_cand a join full_cand b on a.doc_id = b.doc_id and b.value < a.value and cast(b.value as double) / a.value between 0.08 and 0.12 and abs(a.row_idx - b.row_idx) <= 3
  where a.pattern = 'comma' and b.pattern = 'comma' and a.value + b.value between 100 and 500000000
), synth as (
  select doc_id, value, 'synth' as pattern, row_idx, row_pos, text, conf, '' as context, near_above, near_below, 'synth_supply_vat' as source, ordinal from (
    select *, row_number() over (partition by doc_id, value order by ordinal, second) as rn from pairs p
    where (row_pos >= 0.4 or regexp_matches(near_above || near_below, '{_TOTAL}|공급가액|부가세'))
      and not exists (select 1 from full_cand f where f.doc_id = p.doc_id and f.value = p.less)
  ) where rn = 1
)"""
)
MERGED = (
    SYNTH
    + """, every as (select * from cand union all select * from synth
), ranked as (
  select *, row_number() over (partition by doc_id, value order by case source when 'amount_block' then 0 when 'full_ocr' then 1 when 'synth_supply_vat' then 2 else 3 end, conf desc, ordinal) as rn,
    max(case when source = 'full_ocr' then 1 else 0 end) over (partition by doc_id, value) + max(case when source = 'amount_block' then 1 else 0 end) over (partition by doc_id, value) >= 2 as cross_source,
    max(case when source = 'synth_supply_vat' then 1 else 0 end) over (partition by doc_id, value) = 1 and source <> 'synth_supply_vat' as verified_by_synth
  from every
), merged as (select * exclude (rn) from ranked where rn = 1)"""
)
SCORED = (
    MERGED
    + """, sums as (
  select distinct v.doc_id, v.value from merged v join merged a on a.doc_id = v.doc_id and a.value < v.value join merged b on b.doc_id = v.doc_id and b.value = v.value - a.value
  where a.value <> b.value or a.ordinal <> b.ordinal
), totals as (
  select doc_id, value from merged where context like '%합계%' or near_above like '%합계%' or near_below like '%합계%' or source = 'synth_supply_vat'
), parts as (
  select distinct v.doc_id, v.value from merged v join totals t on t.doc_id = v.doc_id and v.value < t.value join merged o on o.doc_id = v.doc_id and o.value = t.value - v.value
  where o.value <> v.value
), marks as (
  select m.*, context like '%합계%' as own_total, near_above like '%합계%' or near_below like '%합계%' as near_total,
    context like '%공급가액%' or context like '%부가세%' as own_partial,
    concat(near_above, ' ', near_below) like '%공급가액%' or concat(near_above, ' ', near_below) like '%부가세%' as near_partial,
    s.value is not null as is_sum, p.value is not null as is_part
  from merged m left join sums s on s.doc_id = m.doc_id and s.value = m.value left join parts p on p.doc_id = m.doc_id and p.value = m.value
), scored as (
  select *, round_even(
    case when own_total or near_total then 40 else 0 end
    + case when own_total and not own_partial then 26 when own_total then 4 when near_total and near_partial then 18 when near_total then 10 else 0 end
    + case when row_pos >= 0.75 then 20 when row_pos >= 0.55 then 10 when row_pos <= 0.25 then -10 else 0 end
    + case when pattern = 'comma' then 10 when pattern = 'bare' and not (own_total or near_total) then -24 when pattern = 'bare' then -14 else 0 end
    + case when context like '%사업자%' then -60 else 0 end
    + case when own_partial and own_total then -8 when own_partial then -25 else 0 end
    + case when row_pos >= 0.9 and pattern = 'bare' and not (own_total or near_total) then case when source = 'amount_block' and conf >= 0.75 then 8 else -30 end else 0 end
    + (conf - 0.5) * 10
    + case when source = 'amount_block' then 28 when source = 'synth_supply_vat' and near_partial then 70 when source = 'synth_supply_vat' then 55 else 0 end
    + case when verified_by_synth then 42 else 0 end + case when cross_source then 14 else 0 end
    + case when is_sum and (own_total or near_total) then 63 when is_sum then 45 else 0 end
    + case when own_partial and not own_total and is_part then -28 else 0 end
    + case when own_total and pattern = 'comma' then 8 else 0 end, 2) as score
  from marks
)"""
)
BEST = SCORED + ", best as (select *, case when score <= -30 then 'all_rejected' when score < 5 then 'low_confidence' else 'selected' end as status from (select *, row_number() over (partition by doc_id order by score desc, value desc, row_pos desc) as rn from scored) where rn = 1)"


def found_of(spark: SparkSession, d: str) -> DataFrame:
    return amounts.row_candidates(clustered_of(spark, d))


def merged_of(spark: SparkSession, d: str) -> DataFrame:
    return amounts.merged(amounts.with_block(amounts.with_synthesised(found_of(spark, d))))


# ---- lines and rows ----
@query(f"with {LINES} select doc_id, line_idx, x, y, w, h, cx, cy, text, conf from lines")
def scan_lines(spark, d):
    return lines_of(spark, d)


@query(f"with {LINES} select doc_id, line_idx, x, y, w, h, cx, cy from lines")
def line_geometry(spark, d):
    """Polygons of four points back to boxes."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x, y, right, low = F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")
    pts = lines_of(spark, d).select("doc_id", "line_idx", "text", F.array(p(x, y), p(right, y), p(right, low), p(x, low)).alias("pts"))
    return rows.geometry(pts).select("doc_id", "line_idx", "x", "y", "w", "h", "cx", "cy")


@query(f"with {OK} select doc_id, count(*) as n_lines, round(min(conf), 4) as least_conf from ok group by doc_id")
def line_filter_conf_size(spark, d):
    return rows.confident(lines_of(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.min("conf"), 4).alias("least_conf"))


_CATEGORY = "case when text is null or text = '' then 'empty' " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in T.CATEGORIES) + r" when length(regexp_replace(text, '\s+', '', 'g')) between 2 and 20 and not regexp_matches(text, '\d') then 'text_candidate' else 'other' end"


@query(f"with {LINES} select category, count(*) as n from (select {_CATEGORY} as category from lines) group by category")
def line_category_counts(spark, d):
    return lines_of(spark, d).groupBy(T.category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


#: A line for each customer, of a shape that its key chooses: one for each branch and some that come near it.
_SHAPES = (
    "null", "''", "'   '", "concat('승인번호 ', cast(c_custkey as string))", "concat('영수증 ', c_name)", "concat('총계 ', cast(c_custkey * 1000 as string))", "concat('123-45 ', cast(10000 + c_custkey % 90000 as string))",
    "concat('220.81.', cast(10000 + c_custkey % 90000 as string))", "concat('012-34-', cast(10000 + c_custkey % 90000 as string))", "concat('(02) 555-', cast(1000 + c_custkey % 9000 as string))", "concat('010 1234 ', cast(1000 + c_custkey % 9000 as string))",
    "concat('경기 성남 ', cast(c_custkey % 100 as string))", "concat('제주점 ', c_mktsegment)", "concat('2024.', cast(1 + c_custkey % 12 as string), '.5')", "concat('24/', cast(10 + c_custkey % 3 as string), '/15')", "'1,234,500'", "concat(cast(c_custkey % 9 + 1 as string), '2500원')",
    "concat('gs25 ', c_mktsegment)", "concat('Coffee ', c_mktsegment)", "'푸른 약국'", "'가나다라'", "lower(c_mktsegment)", "'a'", "concat('item ', cast(c_custkey % 100 as string))",
)
_SHAPED = "select c_custkey as custkey, case " + " ".join(f"when c_custkey % {len(_SHAPES)} = {i} then {x}" for i, x in enumerate(_SHAPES)) + " end as text from "


@query(f"select custkey, {_CATEGORY} as category from ({_SHAPED} customer) q")
def line_categories(spark, d):
    return spark.sql(_SHAPED + "{customer}", customer=read(spark, d, "customer")).select("custkey", T.category(F.col("text")).alias("category"))


@query(f"with {ROWED} select doc_id, line_idx, row_idx from rowed")
def row_cluster_gaps(spark, d):
    return clustered_of(spark, d).select("doc_id", "line_idx", "row_idx")


@query()
def row_cluster_running_mean(spark, d):
    return rows.cluster_rows_running(rows.confident(lines_of(spark, d)))


@query(f"with {TEXTS} select doc_id, row_idx, row_text, round(row_cy, 6) as row_cy from texts")
def row_texts(spark, d):
    return rows.row_texts(clustered_of(spark, d)).withColumn("row_cy", F.round("row_cy", 6))


@query(f"with {NEAR} select doc_id, row_idx, context, near_above, near_below, round(row_pos, 9) as row_pos from near")
def row_neighbour_context(spark, d):
    return near_of(clustered_of(spark, d)).select("doc_id", "row_idx", "context", "near_above", "near_below", F.round("row_pos", 9).alias("row_pos"))


@query(
    f"with {ROWED}, islands as (select *, case when y <= max(y + h) over (partition by doc_id order by y, y + h rows between unbounded preceding and 1 preceding) + 4 then 0 else 1 end as fresh from ok), "
    "numbered as (select *, sum(fresh) over (partition by doc_id order by y, y + h rows unbounded preceding) as band from islands) "
    "select doc_id, cast(band as bigint) as band, min(y) as top, max(y + h) as bottom, count(*) as n from numbered group by doc_id, band"
)
def band_merge_islands(spark, d):
    bands = rows.confident(lines_of(spark, d)).select("doc_id", F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"))
    return rows.merge_bands(bands)


@query(f"with {TEXTS} select doc_id, row_idx, row_text from (select *, row_number() over (partition by doc_id, lower(regexp_replace(row_text, '[\\s[:punct:]]+', '', 'g')) order by row_idx) as rn from texts) where rn = 1")
def row_dedup_first(spark, d):
    return rows.dedup_rows(rows.row_texts(clustered_of(spark, d))).select("doc_id", "row_idx", "row_text")


@query(f"with {TEXTS}, cut as (select *, min(case when contains(regexp_replace(row_text, '\\s+', '', 'g'), '공급가액') then row_idx end) over (partition by doc_id) as stop from texts) select doc_id, row_idx, row_text from cut where stop is null or row_idx < stop")
def stop_keyword_cut(spark, d):
    return rows.stop_at(rows.row_texts(clustered_of(spark, d)), ("공급 가액",)).select("doc_id", "row_idx", "row_text")


@query(f"with {TEXTS}, items as (select *, sum(case when regexp_matches(row_text, '^[a-z]+ [a-z]+') then 1 else 0 end) over (partition by doc_id order by row_idx rows unbounded preceding) as item from texts) select doc_id, cast(item as bigint) as item, count(*) as n_rows, string_agg(row_text, ' | ' order by row_idx) as item_text from items where item > 0 group by doc_id, item")
def item_sessionise(spark, d):
    return rows.sessionise(rows.row_texts(clustered_of(spark, d)), "^[a-z]+ [a-z]+")


@query("select doc_id, cast(pos - 1 as int) as line_idx, line as text, cast(10 + 20 * (pos - 1) as int) as y, cast(greatest(20, least(800, 8 * length(line))) as int) as w from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ls from documents))")
def text_cache_lines(spark, d):
    return sources.text_lines(read(spark, d, "documents")).select("doc_id", "line_idx", "text", "y", "w")


# ---- scalars ----
@query(f"with {TOKENS} select doc_id, row_idx, value, pattern from amounts")
def number_tokens(spark, d):
    c = clustered_of(spark, d)
    return c.select("doc_id", "row_idx", F.explode(T.best_tokens(F.col("text"))).alias("t")).select("doc_id", "row_idx", "t.value", "t.pattern")


_BIZ = f"select c_custkey as custkey, b || cast(({bridge._digits('b')} + c_custkey % 2) % 10 as string) as biz from (select c_custkey, cast(100000000 + (c_custkey * 7919) % 900000000 as string) as b from customer) q"


def biz_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_BIZ.replace("from customer", "from {customer}"), customer=read(spark, d, "customer"))


@query(f"select custkey, substr(biz, 1, 3) || '-' || substr(biz, 4, 2) || '-' || substr(biz, 6, 5) as formatted, custkey % 2 = 0 as valid from ({_BIZ}) q")
def id_checksum_valid(spark, d):
    return biz_of(spark, d).select("custkey", T.biz_format(F.col("biz")).alias("formatted"), T.biz_valid(F.col("biz")).alias("valid"))


@query(f"with {LINES} select doc_id, regexp_extract(text, '(\\d{{3}}-\\d{{2}}-\\d{{5}})', 1) as biz from lines join (select 'R' || cast(o_orderkey as string) as doc_id, o_custkey from orders) o using (doc_id) where text like '사업자번호%' and o_custkey % 2 = 0")
def biz_extract(spark, d):
    return lines_of(spark, d).select("doc_id", T.biz_extract(F.col("text")).alias("biz")).where("biz is not null")


@query("select suppkey, case when substr(p, 1, 2) = '02' and length(p) = 9 then substr(p, 1, 2) || '-' || substr(p, 3, 3) || '-' || substr(p, 6, 4) when substr(p, 1, 2) = '02' then substr(p, 1, 2) || '-' || substr(p, 3, 4) || '-' || substr(p, 7, 4) when length(p) = 10 then substr(p, 1, 3) || '-' || substr(p, 4, 3) || '-' || substr(p, 7, 4) else substr(p, 1, 3) || '-' || substr(p, 4, 4) || '-' || substr(p, 8, 4) end as phone, true as valid from (select s_suppkey as suppkey, case s_suppkey % 4 when 0 then '02' || cast(1000000 + s_suppkey as string) when 1 then '02' || cast(10000000 + s_suppkey as string) when 2 then '031' || cast(1000000 + s_suppkey as string) else '010' || cast(10000000 + s_suppkey as string) end as p from supplier) q")
def phone_format(spark, d):
    k = F.col("s_suppkey")
    number = F.when(k % 4 == 0, F.concat(F.lit("02"), (1000000 + k).cast("string"))).when(k % 4 == 1, F.concat(F.lit("02 "), (10000000 + k).cast("string"))).when(k % 4 == 2, F.concat(F.lit("(031)"), (1000000 + k).cast("string"))).otherwise(F.concat(F.lit("010."), (10000000 + k).cast("string")))
    return read(spark, d, "supplier").select(k.alias("suppkey"), T.phone_format(number).alias("phone"), T.phone_valid(number).alias("valid"))


@query("select o_orderkey as k, cast(cast(o_orderdate as date) as string) as day from orders")
def date_normalise(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    texts = F.when(k % 4 == 0, F.date_format(day, "'거래일' yyyy'년' M'월' d'일'")).when(k % 4 == 1, F.date_format(day, "yyyy.MM.dd")).when((k % 4 == 2) & (F.year(day) >= 2000), F.date_format(day, "'No' yyyyMMdd")).otherwise(F.date_format(day, "yy-M-d"))
    return read(spark, d, "orders").select(k.alias("k"), T.date_normalise(texts).alias("day"))


# ---- amounts ----
_CAND = "doc_id, value, pattern, row_idx, round(row_pos, 9) as row_pos, text, round(conf, 9) as conf, context, near_above, near_below, source"


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", "value", "pattern", "row_idx", F.round("row_pos", 9).alias("row_pos"), "text", F.round("conf", 9).alias("conf"), "context", "near_above", "near_below", "source", *more)


@query(f"with {TOKENS} select {_CAND} from cand")
def amount_candidates(spark, d):
    return shown(amounts.with_block(found_of(spark, d)))


@query(f"with {SYNTH} select {_CAND} from synth")
def supply_vat_synth(spark, d):
    return shown(amounts.synthesised(found_of(spark, d)))


@query(f"with {MERGED} select {_CAND}, cross_source, verified_by_synth from merged")
def candidate_merge_priority(spark, d):
    return shown(merged_of(spark, d), "cross_source", "verified_by_synth")


@query(f"with {SCORED} select doc_id, value from sums")
def checksum_semi(spark, d):
    return amounts.sums_to_others(merged_of(spark, d))


@query(f"with {SCORED} select doc_id, value, source, pattern, score from scored")
def amount_score(spark, d):
    return amounts.scored(merged_of(spark, d)).select("doc_id", "value", "source", "pattern", "score")


@query(f"with {BEST} select doc_id, value, source, score, status from best")
def amount_select_top1(spark, d):
    return amounts.selected(amounts.scored(merged_of(spark, d))).select("doc_id", "value", "source", "score", "status")


_TYPES = "case cast(substr(doc_id, 2) as bigint) % 5 when 0 then 'bank_slip' when 1 then 'form_or_handwritten' when 2 then 'unknown' when 3 then 'receipt_pos' else 'receipt_card' end"
_POLICY = "case when doc_type = 'bank_slip' and score < 40 then 'suppressed_bank_slip' when doc_type = 'form_or_handwritten' and (score < 45 or pattern = 'bare') then 'suppressed_form' when doc_type = 'unknown' and pattern = 'bare' and score < 15 then 'suppressed_unknown' when doc_type in ('receipt_pos', 'receipt_card') and pattern = 'bare' and score < 0 and value >= 10000000 then 'suppressed_receipt_bare_negative' end"


@query(f"with {BEST}, typed as (select *, {_TYPES} as doc_type from best), ruled as (select *, {_POLICY} as suppressed from typed) select doc_id, doc_type, suppressed, case when status = 'selected' and suppressed is null then format('{{:,}}', value) else '' end as amount from ruled")
def amount_policy(spark, d):
    best = amounts.selected(amounts.scored(merged_of(spark, d)))
    return amounts.policy(best.withColumn("doc_type", F.expr(_TYPES))).select("doc_id", "doc_type", "suppressed", "amount")


@query(f"with {TOKENS}, v as (select distinct doc_id, value from amounts where value between 1000 and 100000000) select distinct a.doc_id from v a join v b on a.doc_id = b.doc_id and b.value < a.value and cast(b.value as double) / a.value between 0.08 and 0.12 join v c on c.doc_id = a.doc_id and c.value = a.value + b.value")
def vat_triple_exists(spark, d):
    return parties.has_vat_triple(stored(found_of(spark, d).select("doc_id", "value"), "values"))


@query(
    f"with {TOKENS}, v as (select doc_id, row_idx, value from amounts), p as (select distinct a.doc_id, a.value as supply, b.value as tax, abs(a.row_idx - b.row_idx) as rows_apart from v a join v b on a.doc_id = b.doc_id and cast(b.value as double) / a.value between 0.05 and 0.15 and abs(a.row_idx - b.row_idx) <= 24), "
    "t as (select p.doc_id, supply, tax, rows_apart, max(v.value) as total from p left join v on v.doc_id = p.doc_id and v.value > supply and abs(supply + tax - v.value) <= greatest(2500, floor(greatest(supply + tax, v.value) * 0.001)) group by p.doc_id, supply, tax, rows_apart), "
    "s as (select *, cast(40 + case when total is not null then 30 else 0 end + case when abs(cast(tax as double) / supply - 0.1) <= 0.001 then 10 else 0 end + case when rows_apart <= 3 then 12 else 0 end as int) as score from t) "
    "select doc_id, supply, tax, rows_apart, total, score from (select *, row_number() over (partition by doc_id order by score desc, supply + tax desc, rows_apart, supply desc) as rn from s) where rn = 1"
)
def summary_pair_top1(spark, d):
    v = clustered_of(spark, d).select("doc_id", "row_idx", F.explode(T.best_tokens(F.col("text"))["value"]).alias("value"))
    return parties.summary_pairs(v).withColumn("score", F.col("score").cast("int"))


@query(
    f"with {LINES}, a as (select * from lines where text like '사업자번호%'), b as (select * from lines where text like 'Customer%' or regexp_matches(text, '^[a-z]+ [a-z]+$')), "
    "p as (select a.doc_id, a.line_idx as anchor_idx, a.text as anchor_text, b.line_idx, b.text, round(1.5 * (abs(b.cx - a.cx) / 900) + abs(b.cy - a.cy) / 1200, 6) as cost from a join b on a.doc_id = b.doc_id and abs(b.cx - a.cx) / 900 <= 0.45 and abs(b.cy - a.cy) / 1200 <= 0.28) "
    "select doc_id, anchor_idx, anchor_text, line_idx, text, cost from (select *, row_number() over (partition by doc_id, anchor_idx order by cost, line_idx) as rn from p) where rn = 1"
)
def nearest_company(spark, d):
    lines = lines_of(spark, d)
    others = lines.where(F.col("text").startswith("Customer") | F.col("text").rlike("^[a-z]+ [a-z]+$"))
    return parties.nearest(lines.where(F.col("text").startswith("사업자번호")), others, 900.0, 1200.0)


# ---- item tables ----
_BOUNDS = [("itemName", 0.0, 300.0, 150.0), ("quantity", 380.0, 560.0, 450.0), ("amount", 600.0, 900.0, 700.0)]
_AVG_W = sum(e - s for _, s, e, _ in _BOUNDS) / len(_BOUNDS)
_ITEM = "(regexp_matches(text, '^[a-z]+ [a-z]+') or regexp_matches(text, '^[0-9,]+$'))"
_KEYS = ("itemName", "quantity", "amount")
CELLS = (
    ROWED
    + f""", items as (select * from rowed where {_ITEM}), bounds(key, x_start, x_end, header_cx) as (values {", ".join(f"('{k}', {s}, {e}, {h})" for k, s, e, h in _BOUNDS)}
), cells as (select * from (
  select items.doc_id, row_idx, line_idx, x, case when '1' = substr(doc_id, length(doc_id)) and key = 'quantity' then '-' else text end as text, key,
    row_number() over (partition by doc_id, line_idx order by case when cx >= x_start and cx < x_end then 0 else 1 end, abs(cx - header_cx), key) as rn
  from items join bounds on (cx >= x_start and cx < x_end) or abs(cx - header_cx) <= 0.7 * {_AVG_W}
) where rn = 1), wide as (
  select doc_id, row_idx, coalesce(string_agg(case when key = 'itemName' then text end, ' ' order by x), '') as itemName, coalesce(string_agg(case when key = 'quantity' then text end, ' ' order by x), '') as quantity, coalesce(string_agg(case when key = 'amount' then text end, ' ' order by x), '') as amount
  from cells group by doc_id, row_idx
)"""
)
_LONG = CELLS + ", long as (select doc_id, row_idx, unnest(['itemName', 'quantity', 'amount']) as key, unnest([itemName, quantity, amount]) as v from wide), filled as (select doc_id, key, count(*) filter (lower(trim(v)) not in ('', '-', 'n/a', 'null', 'none', 'undefined')) as filled, count(*) as n_rows from long group by doc_id, key)"


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    bounds = spark.createDataFrame(_BOUNDS, "key string, x_start double, x_end double, header_cx double")
    items = clustered_of(spark, d).where(F.col("text").rlike("^[a-z]+ [a-z]+") | F.col("text").rlike("^[0-9,]+$"))
    cells = tables.assign_columns(items, bounds)
    return cells.withColumn("text", F.when(F.col("doc_id").endswith("1") & (F.col("key") == "quantity"), "-").otherwise(F.col("text")))


def wide_of(spark: SparkSession, d: str) -> DataFrame:
    return tables.cells_to_rows(cells_of(spark, d), _KEYS)


@query(f"with {CELLS} select doc_id, line_idx, row_idx, key, text from cells")
def point_in_interval_cells(spark, d):
    return cells_of(spark, d).select("doc_id", "line_idx", "row_idx", "key", "text")


@query(f"with {CELLS} select doc_id, row_idx, itemName, quantity, amount from wide")
def cells_pivot_rows(spark, d):
    return wide_of(spark, d)


@query(f"with {_LONG} select doc_id, key, filled, n_rows, round_even(filled * 100.0 / n_rows, 1) as fill_rate from filled")
def fill_rate_by_column(spark, d):
    return tables.fill_by_column(wide_of(spark, d), _KEYS).withColumn("fill_rate", F.col("fill_rate").cast("double"))


@query(f"with {_LONG} select doc_id, key from filled where filled = 0")
def missing_keys_except(spark, d):
    return tables.missing_keys(wide_of(spark, d), _KEYS)


@query(f"with {CELLS} select doc_id, count(*) as n_rows, case when count(*) filter (amount not in ('', '-')) > 0 then 'amount' else 'plain' end as profile from wide group by doc_id")
def table_profile(spark, d):
    return tables.table_profile(wide_of(spark, d))


@query(f"with {_LONG} select doc_id, string_agg(case when filled > 0 then key end, ',' order by case key when 'itemName' then 1 when 'quantity' then 2 else 3 end) as columns from filled group by doc_id")
def display_columns(spark, d):
    return tables.display_columns(wide_of(spark, d), _KEYS)


@query(f"with {CELLS} select doc_id, count(*) as n_rows, avg(cast(itemName <> '' as int)) as name_ratio, avg(cast(quantity not in ('', '-') as int)) as quantity_ratio, avg(cast(amount <> '' as int)) as amount_ratio, (avg(cast(itemName <> '' as int)) >= case when count(*) >= 20 then 0.95 else 0.99 end and avg(cast(quantity not in ('', '-') as int)) >= case when count(*) >= 20 then 0.8 else 0.99 end and avg(cast(amount <> '' as int)) >= case when count(*) >= 20 then 0.95 else 0.99 end) as ready from wide group by doc_id")
def release_gate(spark, d):
    w = wide_of(spark, d)
    flags = w.select("doc_id", *((~T.meaningless(F.col(k))).alias(f) for k, f in zip(_KEYS, ("has_name", "has_quantity", "has_amount"))), F.lit(False).alias("forbidden"))
    return evaluate.release_gate(flags).select("doc_id", "n_rows", "name_ratio", "quantity_ratio", "amount_ratio", "ready")


@query(f"with {CELLS}, r as (select *, case when itemName = '' then 'no_name' when quantity in ('', '-') then 'no_quantity' when amount = '' then 'no_amount' end as reason from wide) select reason, count(*) as n, min(itemName) as example from r where reason is not null group by reason")
def drop_reason_counts(spark, d):
    empty = lambda k: T.meaningless(F.col(k))
    return evaluate.drop_reasons(wide_of(spark, d), {"no_name": empty("itemName"), "no_quantity": empty("quantity"), "no_amount": empty("amount")}, "itemName")


@query()
def clean_json_export(spark, d):
    lines = lines_of(spark, d)
    info = lines.groupBy("doc_id").agg(F.max(F.when(F.col("text").startswith("Customer"), F.col("text"))).alias("company"), F.max(F.when(F.col("text").contains("사업자"), T.biz_format(F.col("text")))).alias("biz"))
    return export.clean_json(info, wide_of(spark, d), ["company", "biz"], list(_KEYS))


@query(f"with {CELLS} select doc_id, '## ' || doc_id || chr(10) || chr(10) || '| itemName | quantity | amount |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || itemName || ' | ' || quantity || ' | ' || amount || ' |', chr(10) order by row_idx) as report from wide group by doc_id")
def markdown_report(spark, d):
    return export.markdown(wide_of(spark, d), list(_KEYS))


# ---- restoration ----
_PROFILES = f"profiles as (select biz, c_name as company, case when c_custkey % 7 = 0 then '-' else c_mktsegment end as segment, c_custkey % 30 as updated_at from ({_BIZ}) q join customer on custkey = c_custkey)"
_RECORDS = f"records as (select o_orderkey as record_id, biz, unnest(['company', 'segment']) as field, unnest([case when o_orderkey % 3 = 0 then '' else c_name end, case when o_orderkey % 5 = 0 then 'OTHER' when o_orderkey % 2 = 0 then c_mktsegment else '' end]) as value from orders join customer on o_custkey = c_custkey join ({_BIZ}) q on custkey = c_custkey)"
_RANKED = f"{_PROFILES}, {_RECORDS}, long as (select biz, unnest(['company', 'segment']) as field, unnest([company, segment]) as v from profiles), kept as (select biz, field, v as suggested from long where v not in ('', '-')), ranked as (select r.*, k.suggested, case when k.suggested is null then 'none' when r.value = '' then 'apply' when r.value = k.suggested then 'keep' else 'conflict' end as action from records r left join kept k on k.biz = r.biz and k.field = r.field)"


def restored_of(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, biz = read(spark, d, "customer"), read(spark, d, "orders"), biz_of(spark, d)
    profiles = biz.join(customer, F.col("custkey") == F.col("c_custkey")).select("biz", F.col("c_name").alias("company"), F.when(F.col("c_custkey") % 7 == 0, "-").otherwise(F.col("c_mktsegment")).alias("segment"), (F.col("c_custkey") % 30).alias("updated_at"))
    own = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(biz, F.col("custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    company = F.when(k % 3 == 0, "").otherwise(F.col("c_name"))
    segment = F.when(k % 5 == 0, "OTHER").when(k % 2 == 0, F.col("c_mktsegment")).otherwise("")
    fields = F.array(F.struct(F.lit("company").alias("field"), company.alias("value")), F.struct(F.lit("segment").alias("field"), segment.alias("value")))
    records = own.select(k.alias("record_id"), "biz", F.explode(fields).alias("f")).select("record_id", "biz", "f.field", "f.value")
    suggested = restore.suggestions(restore.profile_candidates(profiles, ("company", "segment")))
    return restore.top_suggestion(records, suggested)


@query(f"with {_RANKED} select record_id, biz, field, value, suggested, action from ranked")
def restore_join_top1(spark, d):
    return restored_of(spark, d).select("record_id", "biz", "field", "value", "suggested", "action")


@query(f"with {_RANKED} select field, action, count(*) as n, count(distinct biz) as n_biz from ranked group by field, action")
def restore_actions_summary(spark, d):
    return restore.action_counts(restored_of(spark, d))


@query("select c_custkey as k, c_name as name, 'old' as origin from customer where c_custkey % 2 <> 0 union all select c_custkey, upper(c_name), 'new' from customer where c_custkey % 2 = 0")
def profile_upsert(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    old = c.where("k % 6 <> 0").withColumn("origin", F.lit("old"))
    new = c.where("k % 2 = 0").select("k", F.upper("name").alias("name"), F.lit("new").alias("origin"))
    return restore.upsert(old, new, ["k"])


@query("select c_custkey as k, case when c_custkey % 4 = 1 then c_name else case when c_custkey % 4 = 3 then null else c_mktsegment end end as v from customer")
def gt_upsert_merge(spark, d):
    c = read(spark, d, "customer")
    old = c.where("c_custkey % 4 <> 3").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 == 1, F.col("c_name")).otherwise("-").alias("v"))
    return restore.merge_fields(old, new, ["k"], ["v"])


# ---- history and log ----
@query("select coalesce(h.k, i.k) as k, coalesce(i.status, h.status) as status, h.total, i.k is not null as indexed from (select o_orderkey as k, o_orderstatus as status, o_totalprice as total from orders where o_orderkey % 6 <> 0) h full outer join (select o_orderkey as k, case when o_orderkey % 4 = 0 then 'C' end as status from orders where o_orderkey % 2 = 0) i on h.k = i.k")
def history_left_join_index(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    index = o.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, "C").alias("status"))
    return history.with_index(o.where("k % 6 <> 0"), index, "k", ["status"])


@query("select o_orderkey as job_id, o_orderpriority as template_name, cast(cast(o_orderdate as date) as string) as created_at, o_orderstatus as status from orders where lower(o_orderpriority) like '%high%' and cast(cast(o_orderdate as date) as string) between '1995-01-01' and '2000-12-31' and o_orderstatus = 'O'")
def history_filter(spark, d):
    h = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("template_name"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return history.filtered(h, keyword="HIGH", since="1995-01-01", until="2000-12-31", status="O")


@query("select event_id, user_id, event_type from events where event_type = 'click' order by ts desc, event_id desc limit 100")
def review_log_tail(spark, d):
    return history.tail(read(spark, d, "events"), 100, "ts", "event_id", where=F.col("event_type") == "click").select("event_id", "user_id", "event_type")


@query("select date_trunc('hour', ts) as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_window_counts(spark, d):
    return log.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("select conv_id, turn, role, coalesce(lag(text) over (partition by conv_id order by turn), '') as before, coalesce(lead(text) over (partition by conv_id order by turn), '') as after from conversations")
def turn_neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.lag("text", 1, "").over(w).alias("before"), F.lead("text", 1, "").over(w).alias("after"))


# ---- evaluation ----
_COMPARED = "compared as (select d.doc_id, lang, case when l.toxic is null then 'none' when l.toxic = cast(length(text) % 2 as int) then 'match' else 'mismatch' end as status from documents d left join labels l using (doc_id))"


def compared_of(spark: SparkSession, d: str) -> DataFrame:
    joined = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return joined.select("doc_id", "lang", evaluate.gt_status((F.length("text") % 2).cast("string"), F.col("toxic").cast("string")).alias("status"))


@query(f"with {_COMPARED} select doc_id, lang, status from compared")
def gt_compare(spark, d):
    return compared_of(spark, d)


@query(f"with {_COMPARED} select lang, count(*) filter (status = 'match') as matched, count(*) filter (status = 'mismatch') as mismatched, count(*) filter (status = 'none') as unknown, round(count(*) filter (status = 'match') / cast(nullif(count(*) filter (status <> 'none'), 0) as double), 4) as match_rate from compared group by lang")
def gt_match_rate(spark, d):
    return evaluate.gt_match_rate(compared_of(spark, d), "lang")


_RUN = "select o_orderkey as k, 'R' || cast(o_orderkey as string) as filename, o_orderstatus as doc_type, o_custkey % {a} <> 0 as selected, o_orderkey % {b} as missing, case when (o_orderkey + o_custkey) % {c} = 0 then 'exact' else 'short' end as row_status from orders"
_DIFF = f"b as ({_RUN.format(a=5, b=3, c=4)} where o_orderkey % 11 <> 0), a as ({_RUN.format(a=7, b=4, c=5)} where o_orderkey % 13 <> 0 or o_orderkey % 11 = 0), diff as (select coalesce(b.filename, a.filename) as filename, coalesce(a.doc_type, b.doc_type) as doc_type, a.missing - b.missing as missing_delta, case when b.k is null then 'new' when a.k is null then 'removed' when ((a.selected and not b.selected) or a.missing < b.missing or (a.row_status = 'exact' and b.row_status <> 'exact')) and ((b.selected and not a.selected) or a.missing > b.missing or (b.row_status = 'exact' and a.row_status <> 'exact')) then 'mixed' when ((a.selected and not b.selected) or a.missing < b.missing or (a.row_status = 'exact' and b.row_status <> 'exact')) then 'improved' when ((b.selected and not a.selected) or a.missing > b.missing or (b.row_status = 'exact' and a.row_status <> 'exact')) then 'regressed' else 'unchanged' end as verdict from b full outer join a on a.filename = b.filename)"


def diff_of(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    run = lambda a, b, c: spark.sql(_RUN.format(a=a, b=b, c=c).replace("from orders", "from {orders}"), orders=orders)
    return evaluate.diff_samples(run(5, 3, 4).where("k % 11 <> 0"), run(7, 4, 5).where("k % 13 <> 0 or k % 11 = 0"))


@query(f"with {_DIFF} select filename, doc_type, missing_delta, verdict from diff")
def snapshot_full_outer_diff(spark, d):
    return diff_of(spark, d)


@query(f"with {_DIFF} select doc_type, verdict, count(*) as n, cast(list_position(['regressed', 'mixed', 'improved', 'unchanged', 'new', 'removed'], verdict) as int) as urgency from diff group by doc_type, verdict")
def verdict_rollup(spark, d):
    return evaluate.verdict_rollup(diff_of(spark, d))


@query("with b as (select event_type, user_id % 50 as bucket, count(*) as n from events where event_id % 2 = 0 group by all), a as (select event_type, user_id % 50 as bucket, count(*) as n from events where event_id % 2 = 1 group by all) select coalesce(b.event_type, a.event_type) as event_type, coalesce(b.bucket, a.bucket) as bucket, coalesce(b.n, 0) as before, coalesce(a.n, 0) as after, coalesce(a.n, 0) - coalesce(b.n, 0) as delta from b full outer join a on a.event_type = b.event_type and a.bucket = b.bucket where coalesce(a.n, 0) <> coalesce(b.n, 0)")
def count_map_diff(spark, d):
    e = read(spark, d, "events")
    count = lambda odd: e.where(F.col("event_id") % 2 == odd).groupBy("event_type", (F.col("user_id") % 50).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return evaluate.diff_counts(count(0), count(1), ["event_type", "bucket"])


@query("with o as (select l_orderkey as k, count(*) as n, max(l_extendedprice) as total from lineitem where l_linenumber % 2 = 1 group by 1), v as (select l_orderkey as k, cast(l_quantity as bigint) % 3 as pos, count(*) as n, max(l_extendedprice) as total from lineitem group by 1, 2), f as (select v.k, min_by(v.pos, v.pos) as pos, min_by(v.n, v.pos) as n from v join o on o.k = v.k and v.n > o.n and coalesce(o.total, 0) <= coalesce(v.total, 0) group by v.k) select o.k as doc_id, case when f.k is null then 'original' else 'v' || cast(f.pos as string) end as chosen, coalesce(f.n, o.n) as n_filled from o left join f on f.k = o.k")
def variant_guard_select(spark, d):
    i = read(spark, d, "lineitem")
    agg = (F.count(F.lit(1)).alias("n_filled"), F.max("l_extendedprice").alias("total"))
    original = i.where("l_linenumber % 2 = 1").groupBy(F.col("l_orderkey").alias("doc_id")).agg(*agg)
    variants = i.groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_quantity").cast("long") % 3).alias("pos")).agg(*agg).withColumn("name", F.concat(F.lit("v"), F.col("pos").cast("string")))
    return evaluate.select_variant(original, variants)


@query("select l_orderkey as doc_id, l_linenumber as line, cast(l_quantity as int) % 4 as tier from lineitem qualify rank() over (partition by l_orderkey order by cast(l_quantity as int) % 4) = 1")
def representative_tier(spark, d):
    i = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("int") % 4).alias("tier"))
    return evaluate.first_tier(i)


@query("with l as (select doc_id, trim(unnest(string_split(text, chr(10)))) as line from documents), b as (select distinct trim(unnest(string_split(text, chr(10)))) as line from benchmark) select doc_id, count(*) as n_unmapped from l where line <> '' and line not in (select line from b) group by doc_id")
def unmapped_lines_anti(spark, d):
    own = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    known = read(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("line")).select(F.trim("line").alias("line")).distinct()
    return own.join(known, "line", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unmapped"))


@query(f"with {LINES}, c as (select doc_id, line_idx, regexp_extract(text, '^(사업자번호|공급가액|부가세|합계|거래일시) (.*)$', 1) as label, regexp_extract(text, '^(사업자번호|공급가액|부가세|합계|거래일시) (.*)$', 2) as value, 0.85 as confidence from lines where regexp_matches(text, '^(사업자번호|공급가액|부가세|합계|거래일시) ') union all select doc_id, line_idx, 'amount', text, 0.55 from lines where regexp_matches(text, '^[0-9]{{1,3}}(,[0-9]{{3}})+$')) select doc_id, line_idx, label, value, cast(confidence as double) as confidence from (select *, row_number() over (partition by doc_id, lower(regexp_replace(value, '[\\s[:punct:]]+', '', 'g')) order by confidence desc, line_idx) as rn from c) where rn = 1")
def candidate_fields_union_dedup(spark, d):
    lines = lines_of(spark, d).select("doc_id", "line_idx", "text")
    pattern = "^(사업자번호|공급가액|부가세|합계|거래일시) (.*)$"
    labelled = lines.where(F.col("text").rlike(pattern)).select("doc_id", "line_idx", F.regexp_extract("text", pattern, 1).alias("label"), F.regexp_extract("text", pattern, 2).alias("value"), F.lit(0.85).alias("confidence"))
    plain = lines.where(F.col("text").rlike(r"^[0-9]{1,3}(,[0-9]{3})+$")).select("doc_id", "line_idx", F.lit("amount").alias("label"), F.col("text").alias("value"), F.lit(0.55).alias("confidence"))
    order = Window.partitionBy("doc_id", T.for_compare(F.col("value"))).orderBy(F.desc("confidence"), "line_idx")
    return labelled.unionByName(plain).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


# ---- bank slips, headers, free-form rows, scores ----
_SLIP = "select o_orderkey as k, o_custkey as c, cast(floor(o_totalprice) as bigint) as total, cast(cast(o_orderdate as date) as string) as day from {orders}"


def slip_lines(spark: SparkSession, d: str) -> DataFrame:
    """A slip for each order: bank, kind, date, amount (every fourth on the next line), balance, masked account."""
    s = spark.sql(_SLIP, orders=read(spark, d, "orders"))
    k = F.col("k")
    fmt = lambda c: F.format_number(c, 0)
    bank = F.element_at(F.array(*map(F.lit, ("국민은행", "신한은행", "우리은행", "어떤곳"))), (k % 4 + 1).cast("int"))
    amount = F.when(k % 4 == 3, F.lit("거래금액")).otherwise(F.concat(F.lit("거래금액 "), fmt(F.col("total"))))
    lines = F.array(bank, F.when(k % 2 == 0, "출금 내역").otherwise("이체 내역"), F.concat(F.lit("일시 "), F.col("day")), amount, F.when(k % 4 == 3, fmt(F.col("total"))).otherwise("메모"), F.concat(F.lit("거래후 잔액 "), fmt(F.col("total") * 3)), F.concat(F.lit("계좌번호 123-"), F.when(k % 5 == 0, "45-67890").otherwise("**-67890")))
    return s.select(F.concat(F.lit("S"), k.cast("string")).alias("doc_id"), F.posexplode(lines).alias("line_idx", "text"))


@query("select 'S' || cast(o_orderkey as string) as doc_id, case o_orderkey % 4 when 0 then '국민은행' when 1 then '신한은행' when 2 then '우리은행' end as bank_name, case when o_orderkey % 2 = 0 then 'withdraw' else 'transfer' end as transaction_type, cast(cast(o_orderdate as date) as string) as transaction_at, cast(floor(o_totalprice) as bigint) as amount, cast(floor(o_totalprice) as bigint) * 3 as balance_after, case when o_orderkey % 5 = 0 then null else '123-**-67890' end as account_masked, case when o_orderkey % 4 = 3 then 'no_bank' else '' end as reasons from orders")
def finance_fields(spark, d):
    from lineweave.operators import finance

    return finance.slip_fields(slip_lines(spark, d))


def headed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The derived lines with a header row of three words at y = 170."""
    lines = lines_of(spark, d)
    words = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(i).alias("i")) for i, (t, x) in enumerate((("품 명", 40.0), ("수량", 420.0), ("금액", 620.0)))))
    heads = lines.select("doc_id").distinct().select("doc_id", F.explode(words).alias("h"))
    made = heads.select("doc_id", (1000 + F.col("h.i")).cast("int").alias("line_idx"), F.col("h.x").alias("x"), F.lit(170.0).alias("y"), F.lit(60.0).alias("w"), F.lit(18.0).alias("h"), (F.col("h.x") + 30).alias("cx"), F.lit(179.0).alias("cy"), F.col("h.text").alias("text"), F.lit(0.9).alias("conf"))
    return lines.unionByName(made)


@query(f"with {ROWED} select doc_id, cast(count(*) filter (cy < 179) as int) as row_idx, 5 as score from (select doc_id, row_idx, min(cy) as cy from rowed group by doc_id, row_idx) group by doc_id")
def header_best_row(spark, d):
    from lineweave.operators import headers

    clustered = rows.cluster_rows(rows.confident(headed_lines(spark, d)))
    return headers.best_header_row(clustered, _KEYS)


@query("select 'R' || cast(o_orderkey as string) as doc_id, unnest(['itemName', 'quantity', 'amount']) as key, unnest([0.0, 260.0, 550.0]::double[]) as x_start, unnest([260.0, 550.0, 1e9]::double[]) as x_end from orders")
def header_boundaries(spark, d):
    from lineweave.operators import headers

    heads = headed_lines(spark, d).where("line_idx >= 1000").withColumn("key", headers.header_key(F.col("text")))
    return tables.boundaries(heads).select("doc_id", "key", "x_start", "x_end")


@query(f"with {OK}, marked as (select *, case when cx - lag(cx) over (partition by doc_id order by cx, line_idx) > 60 then 1 else 0 end as fresh from ok) select doc_id, line_idx, cast(sum(fresh) over (partition by doc_id order by cx, line_idx rows unbounded preceding) as int) as band from marked")
def x_cluster_bands(spark, d):
    from lineweave.operators import headers

    return headers.x_clusters(rows.confident(lines_of(spark, d)), 60.0).select("doc_id", "line_idx", "band")


@query(f"with {TEXTS} select doc_id, row_idx, regexp_extract(row_text, '^([a-z ]+?) ([0-9]+) ([0-9,]+)$', 1) as item_name, regexp_extract(row_text, '^([a-z ]+?) ([0-9]+) ([0-9,]+)$', 2) as quantity, regexp_extract(row_text, '^([a-z ]+?) ([0-9]+) ([0-9,]+)$', 3) as amount from texts where regexp_matches(row_text, '^([a-z ]+?) ([0-9]+) ([0-9,]+)$')")
def item_from_row_text(spark, d):
    from lineweave.operators import headers

    return headers.parse_row_text(rows.row_texts(clustered_of(spark, d)))


@query(f"with {LINES}, tokens as (select unnest(regexp_split_to_array(trim(text), '\\s+')) as t from lines) select class, count(*) as n, count(distinct t) as n_distinct from (select t, case when not regexp_matches(t, '[0-9]') then null when regexp_matches(t, '^(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}$') then 'date' when regexp_matches(t, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{5}}$') then 'biz_number' when regexp_matches(t, '^[0-9]{{1,3}}(,[0-9]{{3}})+$') then 'money' when regexp_matches(t, '[A-Za-z#]') then 'code' when length(t) <= 4 and regexp_matches(t, '^[0-9]+$') then 'quantity' else 'digits' end as class from tokens) where class is not null group by class")
def token_class_counts(spark, d):
    from lineweave.operators import headers

    tokens = lines_of(spark, d).select(F.explode(F.split(F.trim("text"), r"\s+")).alias("t")).select("t", headers.token_class(F.col("t")).alias("class"))
    return tokens.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t").alias("n_distinct"))


@query(f"with {LINES} select doc_id, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from lines group by doc_id")
def box_union(spark, d):
    from lineweave.operators import headers

    return headers.box_union(lines_of(spark, d))


@query(f"with {LINES}, p as (select *, (y + h / 2) / max(y + h) over (partition by doc_id) as r from lines) select doc_id, count(*) as n_lines, count(*) filter (r < 0.3) as upper, count(*) filter (r >= 0.3 and r < 0.7) as middle, count(*) filter (r >= 0.7) as lower from p group by doc_id")
def snapshot_summary(spark, d):
    from lineweave.operators import headers

    return headers.snapshot_summary(lines_of(spark, d)).drop("avg_conf")


@query("select c_custkey as k, round_even(8 * (3 + cast(c_custkey % 2 as int)) + case when c_custkey % 3 = 0 then 12 else 0 end + 8 * (1 - (c_custkey % 10) / 10.0), 4) as address, round_even(22 * (case when c_custkey % 2 = 0 then 4 else 0 end) / 4.0 + 8 * (1 - (c_custkey % 10) / 10.0) + case when c_custkey % 2 = 0 then 14 else 0 end - case when c_custkey % 2 = 1 then 12 else 0 end, 4) as company from customer")
def address_company_scores(spark, d):
    from lineweave.functions import scores

    k = F.col("c_custkey")
    y = (k % 10) / 10.0
    street = F.when(k % 2 == 1, F.lit("서울시 강남구 역삼동 중앙로 12")).otherwise(F.lit("부산시 남구 수영로 77"))
    name = F.when(k % 2 == 0, F.lit("한빛상사")).otherwise(F.lit("ab12"))
    return read(spark, d, "customer").select(k.alias("k"), scores.address_score(street, k % 3 == 0, y).alias("address"), scores.company_score(name, y).alias("company"))


# ---- label windows, triples, templates, variants ----
@query(
    f"with {TOKENS}, labelled as (select doc_id, row_idx as label_row, case when row_text like '%공급가액%' then 'supply' when row_text like '%부가세%' then 'tax' when row_text like '%합계%' then 'total' end as role from texts), "
    "near_by as (select doc_id, role, value, cast(abs(row_idx - label_row) as int) as distance, cast(38 + case when row_idx = label_row then 22 when abs(row_idx - label_row) = 1 then 16 when abs(row_idx - label_row) <= 3 then 10 else 4 end as int) as score from labelled join amounts using (doc_id) where role is not null and abs(row_idx - label_row) <= 18) "
    "select doc_id, role, value, distance, score from (select *, row_number() over (partition by doc_id, role order by score desc, distance, value desc) as rn from near_by) where rn = 1"
)
def label_window_amounts(spark, d):
    c = clustered_of(spark, d).withColumn("values", T.best_tokens(F.col("text"))["value"])
    held = F.flatten(F.collect_list(F.when(F.size("values") > 0, F.col("values")))).alias("values")
    return parties.label_windows(rows.row_texts(c, held), {"supply": "공급가액", "tax": "부가세", "total": "합계"})


@query(
    f"with {TOKENS}, v as (select doc_id, row_idx, value from amounts), p as (select distinct a.doc_id, a.value as supply, b.value as tax, abs(a.row_idx - b.row_idx) as rows_apart from v a join v b on a.doc_id = b.doc_id and cast(b.value as double) / a.value between 0.05 and 0.15 and abs(a.row_idx - b.row_idx) <= 3), "
    "t as (select p.doc_id, supply, tax, rows_apart, max(v.value) as total from p left join v on v.doc_id = p.doc_id and v.value > supply and abs(supply + tax - v.value) <= greatest(2500, floor(greatest(supply + tax, v.value) * 0.001)) group by p.doc_id, supply, tax, rows_apart), "
    "s as (select *, 40 + case when total is not null then 30 else 0 end + case when abs(cast(tax as double) / supply - 0.1) <= 0.001 then 10 else 0 end + 12 as pair_score, cast(40 + case when total is not null then 30 else 0 end + case when abs(cast(tax as double) / supply - 0.1) <= 0.001 then 12 else 0 end + case when rows_apart <= 1 then 8 else 0 end as int) as score from t) "
    "select doc_id, supply, tax, coalesce(total, supply + tax) as total, score from (select *, row_number() over (partition by doc_id order by pair_score desc, supply + tax desc, rows_apart, supply desc) as rn from s) where rn = 1 and score >= 78"
)
def summary_triple_top1(spark, d):
    v = clustered_of(spark, d).select("doc_id", "row_idx", F.explode(T.best_tokens(F.col("text"))["value"]).alias("value"))
    return parties.summary_triples(v)


@query("select p_partkey as id, p_name || cast(p_partkey as string) as name, case when p_partkey % 4 = 0 then 'by id' when p_partkey % 4 = 1 then 'by name' else 'old' end as body from part union all select -p_partkey, 'new' || cast(p_partkey as string), 'added' from part where p_partkey % 4 = 2")
def template_upsert(spark, d):
    """New templates by the id of a stored one, by its name under another id, and under an id of their own. Keys are positive, so negative ids are free."""
    p = read(spark, d, "part")
    k = F.col("p_partkey")
    name = F.concat("p_name", k.cast("string"))
    old = p.select(k.alias("id"), name.alias("name"), F.lit("old").alias("body"))
    new = p.where(k % 4 == 0).select(k.alias("id"), name.alias("name"), F.lit("by id").alias("body"))
    new = new.unionByName(p.where(k % 4 == 1).select((-k).alias("id"), name.alias("name"), F.lit("by name").alias("body")))
    new = new.unionByName(p.where(k % 4 == 2).select((-k).alias("id"), F.concat(F.lit("new"), k.cast("string")).alias("name"), F.lit("added").alias("body")))
    return history.upsert_named(old, new)


@query("select o_orderkey as k, concat_ws(',', case when o_orderkey % 2 = 0 then 'clahe' end, case when o_orderkey % 3 = 0 then 'deskew' end, case when o_orderstatus = 'F' then 'table_crop' end) as variants from orders")
def candidate_variants(spark, d):
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    tags = F.array_compact(F.array(F.when(k % 3 == 0, "skewed"), F.when(k % 2 == 0, "low_contrast")))
    samples = o.select(k.alias("k"), tags.alias("quality_tags"), F.when(F.col("o_orderstatus") == "F", "invoice_statement").otherwise("receipt_pos").alias("doc_type"))
    return evaluate.candidate_variants(samples).select("k", F.array_join("variants", ",").alias("variants"))


from lineweave import across_queries, address_queries, block_queries, columnar_queries, draft_queries, field_queries, kind_queries, layout_queries, snapshot_queries, sourcing_queries, spatial_queries  # noqa: E402, F401  they register their queries, which need ``query``
