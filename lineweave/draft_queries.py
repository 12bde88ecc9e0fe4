"""Registered queries of drafts and stores (operators/drafts.py); fields, rows, edits and stores are derived from orders and their items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineweave.operators import drafts
from lineweave.queries import query, read

_BASE = " union all ".join(
    f"select o_orderkey as doc_id, {i} as place, '{key}' as key, {value} as originalValue, case when o_orderkey % 5 = {i} then 'set' else {value} end as value, o_orderkey % 5 = {i} as edited, cast(o_orderkey % 100 as double) / 100 as confidence, {ko} as labelKo, cast(null as string) as labelEn from {{orders}}"
    for i, (key, value, ko) in enumerate([("biz", "cast(o_custkey as string)", "'사업자번호'"), ("name", "case when o_orderkey % 3 = 0 then '' else 'N' end", "cast(null as string)"), ("total", "cast(cast(floor(o_totalprice) as bigint) as string)", "'합계'")])
)
_EDITS = """select o_orderkey as doc_id, 0 as seq, 'name' as key, case when o_orderkey % 2 = 0 then 'N' else 'M' end as value, cast(null as double) as confidence, 'x' as labelKo, cast(null as string) as labelEn from {orders}
  union all select o_orderkey, 1, 'memo', 'first', 0.5, '메모', ' ' from {orders} where o_orderkey % 3 <> 1
  union all select o_orderkey, 2, 'memo', case when o_orderkey % 2 = 0 then '' else 'last' end, 0.9, '둘째', 'memo' from {orders} where o_orderkey % 4 <> 1
  union all select o_orderkey, 3, ' ', 'lost', 0.1, 'x', 'x' from {orders}
  union all select o_orderkey, 4, 'extra', cast(null as string), 0.2, '', 'extra' from {orders} where o_orderkey % 7 = 0
  union all select o_orderkey, 5, 'total', cast(cast(floor(o_totalprice) as bigint) as string), 0.3, 'x', 'x' from {orders} where o_orderkey % 2 = 0"""
_F = f"b as ({_BASE}), e as ({_EDITS})".replace("{orders}", "orders")


@query(
    f"""with {_F}, g as (
  select doc_id, key, min(seq) as e_seq, arg_max(coalesce(value, ''), seq) as e_value, arg_min(struct_pack(c := confidence, ko := nullif(trim(labelKo), ''), en := nullif(trim(labelEn), '')), seq) as f from e where trim(key) <> '' group by doc_id, key
), j as (select coalesce(b.doc_id, g.doc_id) as doc_id, coalesce(b.key, g.key) as key, b.place, coalesce(originalValue, '') as originalValue, coalesce(e_value, value, '') as value, edited as was, b.confidence as bc, labelKo, labelEn, e_seq, f, b.key is not null as old from b full join g on g.doc_id = b.doc_id and g.key = b.key
), k as (select *, case when e_seq is not null then value <> originalValue else coalesce(was, false) end as edited from j)
select doc_id, cast(row_number() over (partition by doc_id order by not old, case when old then place else e_seq end) - 1 as int) as place, key, originalValue as "originalValue", value, edited, case when old then bc else f.c end as confidence, case when old then labelKo else f.ko end as "labelKo", case when old then labelEn else f.en end as "labelEn",
  case when value = '' then 'not_reviewed' when e_seq is not null and edited then 'present_corrected' else 'present_extracted' end as "fieldStatus" from k"""
)
def merged_draft_fields(spark, d):
    orders = read(spark, d, "orders")
    return drafts.merged_fields(spark.sql(_BASE, orders=orders), spark.sql(_EDITS, orders=orders))


_ITEMS = "select l_orderkey as doc_id, l_partkey as p, l_quantity as q, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice) as int) as n from {lineitem}"
# documents of k % 11 = 0 have no table; every third row is edited, and some documents have one edited row too many
_ROWS = f"select doc_id, n as rowIndex, concat('P', cast(p as string)) as itemName, cast(null as string) as spec, cast(p as string) as productCode, '' as lotNo, '' as expiryDate, cast(cast(q as int) as string) as quantity, '1' as unitPrice, '' as amount from ({_ITEMS}) i where doc_id % 11 <> 0"
_I = _ITEMS.replace("{lineitem}", "lineitem")
_R = f"r as ({_ROWS}), i as ({_I})".replace("{lineitem}", "lineitem")


def _tables(spark, d):
    items = spark.sql(_ITEMS, lineitem=read(spark, d, "lineitem"))
    n, k = F.col("n"), F.col("doc_id")
    cell = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    edited = F.array(cell("qty", n * 2), cell("quantity", n * 3), cell("total", F.col("p")), cell("color", n))
    plain = F.when(n % 2 == 0, F.array(cell("spec", F.lit("S")), cell("item", F.lit(None)))).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    edits = items.where(k % 2 == 0).select("doc_id", (n - 1).alias("row_idx"), F.when(n % 3 == 0, edited).when(n % 5 == 4, None).otherwise(plain).alias("cells"))
    more = items.where((k % 6 == 0) & (n == 1)).join(items.groupBy("doc_id").agg(F.max("n").alias("m")), "doc_id").select("doc_id", F.col("m").alias("row_idx"), F.array(cell("color", F.col("n"))).alias("cells"))
    return spark.sql(_ROWS, lineitem=read(spark, d, "lineitem")), edits.unionByName(more)


@query(
    f"""with {_R}, m as (select r.*, doc_id % 2 = 0 and rowIndex % 3 = 0 as full_, doc_id % 2 = 0 and rowIndex % 3 <> 0 and rowIndex % 5 <> 4 and rowIndex % 2 = 0 as plain_ from r)
select doc_id, rowIndex as "rowIndex", case when plain_ then '' else itemName end as "itemName", case when plain_ then 'S' else '' end as spec, productCode as "productCode", lotNo as "lotNo", expiryDate as "expiryDate", case when full_ then cast(rowIndex * 3 as varchar) else quantity end as quantity, unitPrice as "unitPrice",
  case when full_ then productCode else '' end as amount, concat_ws(',', 'itemName:' || case when plain_ then 'present_corrected' else 'present_extracted' end, 'spec:' || case when plain_ then 'present_corrected' else 'not_reviewed' end, 'productCode:present_extracted', 'lotNo:not_reviewed', 'expiryDate:not_reviewed',
  'quantity:' || case when full_ then 'present_corrected' else 'present_extracted' end, 'unitPrice:present_extracted', 'amount:' || case when full_ then 'present_corrected' else 'not_reviewed' end) as status from m"""
)
def merged_draft_table(spark, d):
    merged = drafts.merged_table(*_tables(spark, d))
    status = F.concat_ws(",", *(F.concat(F.lit(k + ":"), F.col("fieldStatus")[k]) for k in drafts.FIELD_KEYS))
    return merged.withColumn("status", status).drop("fieldStatus")


@query(
    f"""with {_R}, n as (select doc_id, count(*) as c from i group by doc_id), s as (select *, doc_id % 11 <> 0 as has_rows, doc_id % 2 = 0 as has_edits from n where doc_id % 11 <> 0 or doc_id % 2 = 0)
select doc_id, case when not has_rows then 'no_base_table_for_edits' when not has_edits then '' else concat_ws(',', case when doc_id % 6 = 0 then 'row_count_mismatch' end, case when c >= 3 then 'unknown_column_key' end) end as warnings, not has_rows as export_blocked from s"""
)
def draft_table_warnings(spark, d):
    return drafts.table_warnings(*_tables(spark, d)).withColumn("warnings", F.array_join("warnings", ","))


_JSON = """case o_orderkey % 7
  when 0 then concat('{{"a.png": {{"fields": {{"회사명": "C', cast(o_custkey as string), '", "합계": 12}}, "type": "invoice", "updated_at": "2024-01-01", "ocr_text": "T', cast(o_orderkey as string), '"}}, "n": 5, "s": "x"}}')
  when 1 then concat('{{"b.png": {{"회사명": "D', cast(o_custkey as string), '"}}}}')
  when 2 then concat('{{"c.png": {{"fields": {{}}, "financeFields": {{"은행": "B', cast(o_custkey % 9 as string), '"}}, "ocr_text": ""}}}}')
  when 3 then '{{"broken'
  when 4 then '{{}}'
  when 5 then concat('{{"a.png": {{"fields": {{"회사명": "E"}}, "type": "", "documentFields": "x", "ocr_text": "U', cast(o_orderkey as string), '", "updated_at": "2024-02-02"}}}}')
  else '' end""".replace("{{", "{").replace("}}", "}")


def _stores(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("dataset"), F.expr(_JSON).alias("json"))


@query(
    """with s as (select o_orderkey as dataset, o_custkey as c, o_orderkey % 7 as v from orders)
select dataset, case v when 0 then 'a.png' when 1 then 'b.png' when 2 then 'c.png' when 5 then 'a.png' end as key, case v when 0 then '합계=12,회사명=C' || c when 1 then '회사명=D' || c when 2 then '' when 5 then '회사명=E' end as fields, case v when 0 then 'invoice' when 3 then null else '영수증' end as type,
  case v when 0 then '2024-01-01' when 3 then null when 5 then '2024-02-02' else '' end as updated_at, case when v = 2 then 'B' || (c % 9) end as bank, case v when 0 then 'T' || dataset when 5 then 'U' || dataset end as ocr_text, v = 3 as bad from s where v not in (4, 6)"""
)
def migrated_store(spark, d):
    m = drafts.migrated(_stores(spark, d))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("dataset", "key", pairs.alias("fields"), "type", "updated_at", F.col("financeFields")["은행"].alias("bank"), "ocr_text", "bad")


@query(
    """select o_orderkey as dataset, 'a.png' as key, case when o_orderkey % 2 = 0 then 'old' when o_orderkey % 7 = 0 then 'T' || o_orderkey else 'U' || o_orderkey end as ocr_text, case when o_orderkey % 2 = 0 then '' when o_orderkey % 7 = 0 then '2024-01-01' else '2024-02-02' end as scanned_at
from orders where o_orderkey % 2 = 0 or o_orderkey % 7 in (0, 5)"""
)
def migrated_cache(spark, d):
    cache = read(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("dataset"), F.lit("a.png").alias("key"), F.lit("old").alias("ocr_text"), F.lit("").alias("scanned_at"))
    records = drafts.migrated(_stores(spark, d))
    return drafts.cache_of(records, drafts.cache_of(records, cache))
