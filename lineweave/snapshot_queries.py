"""Registered queries of differences of two runs, whose samples are the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.operators import snapshots
from lineweave.queries import query, read

_FIELDS = ("companyName", "bizNumber", "totalAmount", "issueDate")
_WARNINGS = ("column_shift", "row_count", "blank_value")


def _run(t: str, a: int, b: int) -> str:
    """Samples of a run: which fields are missing and what is warned of depend on ``a`` and ``b``."""
    names = lambda which, m: "concat_ws(',', " + ", ".join(f"case when (k + {i} * c) % {m + i} = 0 then '{n}' end" for i, n in enumerate(which)) + ")"
    return f"""select concat('R', cast(k as string)) as filename, case when k % {a * 10} = 0 then null when k % {b * 3} = 0 then 'moved' else s end as doc_type, case when c % {a} = 0 then 'rejected' when c % 41 = 0 then null else 'selected' end as status,
  case when k % {b} = 0 then 'fallback' else 'table' end as source, case (k + c) % {b} when 0 then 'short' when 1 then 'over' else 'exact' end as row_status, case when k % 17 <> 0 then cast(k % {a + b} as int) end as actual_rows,
  {names(_FIELDS, a)} as missing_, {names(_WARNINGS, b)} as warnings_, k from (select o_orderkey as k, o_custkey as c, o_orderstatus as s from {t}) q"""


_ONLY_AFTER, _ONLY_BEFORE = "k % 11 = 0", "k % 13 = 0 and k % 11 <> 0"
_LISTS = "list_filter(string_split(missing_, ','), lambda x: x <> '') as missing, list_filter(string_split(warnings_, ','), lambda x: x <> '') as warnings"
_RUNS = f"b as (select *, {_LISTS} from ({_run('orders', 5, 3)}) r where not ({_ONLY_AFTER})), a as (select *, {_LISTS} from ({_run('orders', 7, 4)}) r where not ({_ONLY_BEFORE}))"


def runs_of(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders")
    named = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c[:-1])
    run = lambda a, b, but: spark.sql(_run("{orders}", a, b), orders=orders).where(f"not ({but})").select("*", named("missing_"), named("warnings_"))
    return run(5, 3, _ONLY_AFTER), run(7, 4, _ONLY_BEFORE)


_GAINED, _LOST = "coalesce(a.{c} = '{v}', false) and not coalesce(b.{c} = '{v}', false)", "coalesce(b.{c} = '{v}', false) and not coalesce(a.{c} = '{v}', false)"
_TEXTS = lambda how, sign: "concat_ws('; ', " + ", ".join([
    f"case when both_ and {how.format(c='row_status', v='exact')} then 'rowCount: ' || coalesce(b.row_status, '') || ' → ' || coalesce(a.row_status, '') end",
    f"case when both_ and len(a.missing) {sign} len(b.missing) then 'missing: ' || len(b.missing) || ' → ' || len(a.missing) end",
    f"case when both_ and {how.format(c='status', v='selected')} then 'status: ' || coalesce(b.status, '') || ' → ' || coalesce(a.status, '') end",
]) + ")"
_CHANGED = ", ".join(f"case when both_ then a.{c} is distinct from b.{c} end as {c}_changed" for c in ("doc_type", "status", "source", "row_status"))


@query(
    f"""with {_RUNS}, met as (select b, a, b.filename is not null and a.filename is not null as both_ from b full outer join a on a.filename = b.filename
), told as (
  select coalesce(b.filename, a.filename) as filename, both_, b.filename is null as fresh, {_TEXTS(_GAINED, '<')} as improvements, {_TEXTS(_LOST, '>')} as regressions, coalesce(a.actual_rows, 0) - coalesce(b.actual_rows, 0) as rows_delta,
    len(a.missing) - len(b.missing) as missing_delta, len(a.warnings) - len(b.warnings) as warning_delta, {_CHANGED} from met
)
select filename, improvements, regressions, case when both_ then cast(rows_delta as int) end as rows_delta, cast(missing_delta as int) as missing_delta, cast(warning_delta as int) as warning_delta, doc_type_changed, status_changed, source_changed, row_status_changed,
  case when both_ then case when improvements <> '' and regressions <> '' then 'mixed' when improvements <> '' then 'improved' when regressions <> '' then 'regressed' else 'unchanged' end when fresh then 'new' else 'removed' end as verdict from told"""
)
def snapshot_sample_changes(spark, d):
    told = snapshots.sample_changes(*runs_of(spark, d))
    return told.withColumns({c: F.array_join(c, "; ") for c in ("improvements", "regressions")})


def _names(of: str) -> str:
    return f"""b_{of} as (select coalesce(doc_type, '') as doc_type, unnest({of}) as name from b), a_{of} as (select coalesce(doc_type, '') as doc_type, unnest({of}) as name from a
), {of}_changes as (
  select coalesce(x.doc_type, y.doc_type) as doc_type, coalesce(x.name, y.name) as name, coalesce(x.n, 0) as before, coalesce(y.n, 0) as after, coalesce(y.n, 0) - coalesce(x.n, 0) as delta
  from (select doc_type, name, count(*) as n from b_{of} group by all) x full outer join (select doc_type, name, count(*) as n from a_{of} group by all) y on x.doc_type = y.doc_type and x.name = y.name where coalesce(x.n, 0) <> coalesce(y.n, 0)
)"""


@query(f"with {_RUNS}, {_names('missing')} select * from missing_changes")
def snapshot_missing_fields(spark, d):
    return snapshots.name_changes(*runs_of(spark, d), "missing")


@query(f"with {_RUNS}, {_names('warnings')} select * from warnings_changes")
def snapshot_warnings(spark, d):
    return snapshots.name_changes(*runs_of(spark, d), "warnings")


_COUNT = "count(*) as total, count(*) filter (status = 'selected') as selected, " + ", ".join(f"count(*) filter (row_status = '{s}') as row_{s}" for s in ("exact", "short", "over")) + ", count(*) filter (len(warnings) > 0) as warned"
_SIDES = ", ".join(f"coalesce({s}.{c}, 0) as {n}_{c}" for s, n in (("x", "before"), ("y", "after")) for c in snapshots.COUNTS)
_DELTAS = ", ".join(f"after_{c} - before_{c} as {c}_delta" for c in snapshots.COUNTS[2:])


@query(
    f"""with {_RUNS}, {_names('missing')}, sides as (
  select coalesce(x.doc_type, y.doc_type) as doc_type, {_SIDES} from (select coalesce(doc_type, '') as doc_type, {_COUNT} from b group by 1) x full outer join (select coalesce(doc_type, '') as doc_type, {_COUNT} from a group by 1) y on x.doc_type = y.doc_type
), deltas as (
  select *, {_DELTAS}, cast(coalesce((select sum(delta) from missing_changes m where m.doc_type = sides.doc_type), 0) as bigint) as missing_delta from sides
)
select *, case when row_exact_delta > 0 or missing_delta < 0 then 'improved' when row_exact_delta < 0 or missing_delta > 0 then 'regressed' else 'unchanged' end as verdict from deltas"""
)
def snapshot_type_changes(spark, d):
    return snapshots.type_changes(*runs_of(spark, d))
