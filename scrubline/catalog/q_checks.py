"""Queries on contracts, verdicts, differences and patches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import apply_step
from ..plans import diff, verify
from ..plans.contract import contract_summary, validate
from ..plans.profile import profile
from ..session import stage
from . import duck_profile as D
from . import q_convert as C
from .q_columns import duck_fold
from .registry import query
from .views import table, view

ORDERS = ("dirty_orders",)
OC = D.ORDERS_COLUMNS


def _rule(rule: str, col: str | None, n: str, detail: str = "''") -> str:
    name = "cast(null as varchar)" if col is None else f"'{col}'"
    return (f"select '{rule}' as rule, {name} as col, cast(v as bigint) as violations, "
            f"v = 0 as passed, {detail} as detail from (select {n} as v from dirty_orders)")


_BAD_TOTAL = ("count(*) filter (where try_cast(total as double) < 50000 or "
              "try_cast(total as double) > 300000 or "
              "(total is not null and try_cast(total as double) is null))")
_RULES = {
    "contract_min_rows": (
        {"table": {"min_rows": 20000}, "columns": {}},
        [_rule("min_rows", None, "cast(count(*) < 20000 as integer)",
               "(select count(*) from dirty_orders) || ' rows, need >= 20000'")]),
    "contract_no_duplicate_rows": (
        {"table": {"no_duplicate_rows": True}, "columns": {}},
        [_rule("no_duplicate_rows", None,
               "count(*) - (select count(*) from (select distinct * from dirty_orders))")]),
    "contract_column_exists": (
        {"columns": {"ghost": {"not_null": True}, "maybe": {"required": False, "unique": True}}},
        [_rule("column_exists", "ghost", "max(1)", "'column is missing'")]),
    "contract_not_null": (
        {"columns": {"active": {"not_null": True}, "order_id": {"not_null": True}}},
        [_rule("not_null", c, f"count(*) - count({c})") for c in ("active", "order_id")]),
    "contract_unique": (
        {"columns": {"order_id": {"unique": True}, "priority": {"unique": True}}},
        [_rule("unique", c, f"count(*) - count(distinct {c}) - "
                            f"cast(count(*) > count({c}) as integer)")
         for c in ("order_id", "priority")]),
    "contract_range": (
        {"columns": {"total": {"min": 50000, "max": 300000}, "order_id": {"max": 14000}}},
        [_rule("range", "total", _BAD_TOTAL, "'[50000, 300000]'"),
         _rule("range", "order_id", "count(*) filter (where order_id > 14000)",
               "'[-inf, 14000]'")]),
    "contract_allowed": (
        {"columns": {"active": {"allowed": ["yes", "No"]}}},
        [_rule("allowed", "active", "count(*) filter (where active not in ('yes', 'No'))",
               "'allowed: [''yes'', ''No'']'")]),
    "contract_regex": (
        {"columns": {"order_date": {"regex": r"\d{4}"}}},
        [_rule("regex", "order_date",
               r"count(*) filter (where not regexp_matches(order_date, '^\d{4}'))",
               r"'\d{4}'")]),
}


def _contract(key: str, contract: dict, rules: list[str]) -> None:
    @query(key, uses=ORDERS, sql=" union all ".join(rules))
    def _(spark, sf):
        return validate(view(spark, sf, "dirty_orders"), contract)


for _key, (_c, _r) in _RULES.items():
    _contract(_key, _c, _r)

CONTRACT = {"table": {"min_rows": 1, "no_duplicate_rows": True},
            "columns": {k: v for c, _ in list(_RULES.values())[2:]
                        for k, v in c["columns"].items()}}
_ALL = [_rule("min_rows", None, "cast(count(*) < 1 as integer)",
              "(select count(*) from dirty_orders) || ' rows, need >= 1'"),
        *_RULES["contract_no_duplicate_rows"][1], *_RULES["contract_column_exists"][1],
        *_RULES["contract_allowed"][1], *_RULES["contract_range"][1],
        _RULES["contract_unique"][1][1], *_RULES["contract_regex"][1]]


@query("contract_report", uses=ORDERS, sql=" union all ".join(_ALL))
def _(spark, sf):
    return validate(view(spark, sf, "dirty_orders"), CONTRACT)


@query("contract_summary", uses=ORDERS, sql=f"""
select bool_and(passed) as passed, cast(sum(violations) as bigint) as n_violations,
  count(*) as n_rules from ({' union all '.join(_ALL)})""")
def _(spark, sf):
    return contract_summary(validate(view(spark, sf, "dirty_orders"), CONTRACT))


@query("contract_lineitem", sql="""
select 'not_null' as rule, 'l_shipdate' as col, count(*) - count(l_shipdate) as violations,
  count(*) = count(l_shipdate) as passed, '' as detail from lineitem
union all select 'range', 'l_discount', count(*) filter (where l_discount > 0.08),
  count(*) filter (where l_discount > 0.08) = 0, '[0, 0.08]' from lineitem
union all select 'allowed', 'l_returnflag', count(*) filter (where l_returnflag <> 'N'),
  count(*) filter (where l_returnflag <> 'N') = 0, 'allowed: [''N'']' from lineitem""")
def _(spark, sf):
    return validate(table(spark, sf, "lineitem"), {"columns": {
        "l_shipdate": {"not_null": True}, "l_discount": {"min": 0, "max": 0.08},
        "l_returnflag": {"allowed": ["N"]}}})


# The recipe that turns dirty_orders into its second version.  Quantities are
# left out, so one issue stays open.
RECIPE = [
    {"tool": t, "col": c, "params": p, "reason": "fixed recipe"} for t, c, p in (
        ("drop_blank_rows", None, {}), ("drop_duplicates", None, {}),
        ("normalize_dates", "order_date", {}), ("normalize_currency", "total", {}),
        ("normalize_phone", "phone", {}), ("trim_whitespace", "priority", {}),
        ("standardize_categories", "priority", {}),
        ("fix_dtypes", "active", {"target": "bool"}),
        ("impute_missing", "qty_text", {"strategy": "flag_only"}))]

V2_CTES = f"""
clean_rows as (select distinct * from dirty_orders where order_id is not null),
trimmed as (select * replace (nfc_normalize(trim(regexp_replace(priority, '\\s+', ' ', 'g')))
  as priority) from clean_rows),
{C.duck_standard('priority', 'trimmed')},
v2 as (select t.* replace ({C.duck_date('order_date')} as order_date,
    {C.duck_amount('total')} as total, {C.duck_phone('phone')} as phone,
    coalesce(v, priority) as priority, {C.duck_bool('active')} as active),
  {C.duck_code('total')} as total_currency, qty_text is null as qty_text_missing
  from trimmed t left join canon on {duck_fold('priority')} = k)"""
V2_COLUMNS = {**OC, "total": "number", "active": "bool", "total_currency": "text",
              "qty_text_missing": "bool"}


def second_version(spark, sf):
    from ..plans.recipe import run_recipe
    return run_recipe(view(spark, sf, "dirty_orders"), RECIPE).df


# Both profiles in SQL; the verdict rules are written out again here.
_PROFILES = (
    f"with {V2_CTES}, {D.profile_cte('pb', 'dirty_orders', OC)}, "
    f"{D.by_column_cte('cb', 'pb')}, {D.by_table_cte('tb', 'pb')}, "
    f"{D.sizes_cte('sb', 'cb', 'tb')}, {D.profile_cte('pa', 'v2', V2_COLUMNS)}, "
    f"{D.by_column_cte('ca', 'pa')}, {D.by_table_cte('ta', 'pa')}, "
    f"{D.sizes_cte('sa', 'ca', 'ta')}, ")
_VERDICTS = f"""verdicts as (
select coalesce(sb.issue, sa.issue) as issue, coalesce(sb.col, sa.col) as col,
  coalesce(sb.size, 0) as before, coalesce(sa.size, 0) as after,
  case when coalesce(sb.issue, sa.issue) in ('nulls', 'outliers') and
      coalesce(sb.col, sa.col) || case coalesce(sb.issue, sa.issue) when 'nulls'
        then '_missing' else '_outlier' end in (select col from ca) then 'flagged'
    when sa.size is null then 'resolved'
    when coalesce(sb.issue, sa.issue) in ('nulls', 'outliers') then 'unresolved'
    when sb.size is null then 'new_issue'
    when sa.size < sb.size then 'partially_resolved' else 'unresolved' end as verdict
from sb full join (select * from sa where col is null or col in (select col from cb)) sa
  on sb.issue = sa.issue and sb.col is not distinct from sa.col
union all
select issue, col, 0, size, 'new_issue' from sa where col not in (select col from cb)
  and issue not in ('nulls', 'outliers')
  and not regexp_matches(col, '(_missing|_outlier|_invalid|_currency|_code)$'))"""


def _profiles(spark, sf):
    """Profiles of both versions; each version is written once, so that the
    passes read columns instead of building the rows again."""
    from ..plans.recipe import run_recipe
    before = stage(view(spark, sf, "dirty_orders"), "before")
    after = stage(run_recipe(before, RECIPE).df, "after")
    return profile(before), profile(after)


@query("verify_profiles", uses=ORDERS, sql=f"{_PROFILES}{_VERDICTS} select * from verdicts")
def _(spark, sf):
    return verify.verify_profiles(*_profiles(spark, sf))


@query("verify_table_signals", uses=ORDERS,
       sql=f"{_PROFILES}{_VERDICTS} select * from verdicts where col is null")
def _(spark, sf):
    return verify.verify_profiles(*_profiles(spark, sf)).filter("col is null")


_WIDER = "(select *, phone as second_phone, phone as alt_code from dirty_orders)"


@query("verify_new_columns", uses=ORDERS, sql=f"""
with {D.profile_cte('pa', 'wider', {'second_phone': 'text'})}, {D.by_column_cte('ca', 'pa')},
{D.by_table_cte('ta', 'pa')}, {D.sizes_cte('sa', 'ca', 'ta')}
select issue, col, 0.0::double as before, size as after, 'new_issue' as verdict from sa
where col = 'second_phone' and issue not in ('nulls', 'outliers')""".replace(
    "from wider", f"from {_WIDER}"))
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    wider = df.withColumns({"second_phone": F.col("phone"), "alt_code": F.col("phone")})
    return verify.verify_profiles(profile(df), profile(wider)).filter(
        "verdict = 'new_issue'")


@query("follow_up_steps", uses=ORDERS, sql=f"""
{_PROFILES}{_VERDICTS}, steps as (select cast(row_number() over (order by place, rank)
  as integer) as ord, tool, col, params, reason from ({D.steps_sql('ca', 'ta')}))
select * from steps where exists (select 1 from verdicts v where v.verdict in
  ('unresolved', 'partially_resolved', 'new_issue') and v.col is not distinct from steps.col
  and {D.lit(json.dumps(verify.FOLLOW_UP_TOOL))}::json ->> v.issue = steps.tool)""")
def _(spark, sf):
    before, after = _profiles(spark, sf)
    return verify.follow_up_steps(verify.verify_profiles(before, after), after)


@query("targeted_verdicts", uses=ORDERS, sql=f"""
{_PROFILES}{_VERDICTS} select * from verdicts where verdict = 'new_issue'
  or issue = 'duplicates' or (issue = 'mixed_date_formats' and col = 'order_date')
  or (issue in ('currency_strings', 'numeric_as_string') and col = 'total')""")
def _(spark, sf):
    verdicts = verify.verify_profiles(*_profiles(spark, sf))
    aimed = [s for s in RECIPE
             if s["tool"] in ("drop_duplicates", "normalize_dates", "normalize_currency")]
    return verify.targeted_verdicts(verdicts, aimed)


def _duck_text(c: str, kind: str) -> str:
    if kind == "bool":
        return f"case when {c} then 'True' when not {c} then 'False' end"
    return f"cast({c} as varchar)"


_CELLS = "cells as (" + " union all ".join(
    f"select cast(b.order_id as varchar) as key, '{c}' as col, cast(b.{c} as varchar) as before, "
    f"{_duck_text(f'a.{c}', V2_COLUMNS[c])} as after from clean_rows b join v2 a "
    f"on a.order_id = b.order_id" for c in OC if c != "order_id") + ")"


@query("diff_cells", uses=ORDERS, sql=f"""
with {V2_CTES}, {_CELLS} select * from cells where before is distinct from after""")
def _(spark, sf):
    return diff.diff_cells(view(spark, sf, "dirty_orders"), second_version(spark, sf),
                           "order_id")


@query("diff_rows", uses=ORDERS, sql="""
select distinct order_id as key from dirty_orders
where order_id is not null and lower(active) = 'no'""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    after = apply_step(df, "drop_rows_where", "active", {"equals": "no", "match_case": False})
    return diff.removed_rows(df, after, "order_id")


@query("diff_summary", uses=ORDERS, sql=f"""
with {V2_CTES}, {_CELLS} select col, count(*) as n_changed from cells
where before is distinct from after group by col""")
def _(spark, sf):
    return diff.diff_summary(diff.diff_cells(
        view(spark, sf, "dirty_orders"), second_version(spark, sf), "order_id"))


@query("patch_cells", sql="""
select s_suppkey, case when s_suppkey % 10 = 0 then 'Edited ' || s_suppkey else s_name end
  as s_name, s_nationkey, case when s_suppkey % 15 = 0 then null
  when s_suppkey % 7 = 0 then 12.5 else s_acctbal end as s_acctbal from supplier""")
def _(spark, sf):
    df = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    edits = (df.filter(key % 10 == 0).select(
        key.alias("key"), F.lit("s_name").alias("col"),
        F.concat(F.lit("Edited "), key.cast("string")).alias("value"))
        .unionByName(df.filter((key % 15 == 0) | (key % 7 == 0)).select(
            key.alias("key"), F.lit("s_acctbal").alias("col"),
            F.when(key % 15 == 0, "").otherwise("12.5").alias("value"))))
    return diff.patch_cells(df, edits, "s_suppkey")


def _mixed_edits(df):
    """Edits that repeat, and that do not fit."""
    key = F.col("s_suppkey")
    picks = [(key % 4 == 0, "9", 1), (key % 4 == 0, "10", 2), (key % 6 == 0, "abc", 3)]
    return [df.filter(hit).select(key.alias("key"), F.lit("s_acctbal").alias("col"),
                                  F.lit(value).alias("value"), F.lit(n).alias("n")) for hit, value, n in picks]


@query("patch_cells_last", sql="""
select s_suppkey, case when s_suppkey % 4 = 0 then 10.0 else s_acctbal end as s_acctbal from supplier""")
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    first, second, _ = _mixed_edits(df)
    return diff.patch_cells(df, first.unionByName(second), "s_suppkey", "n")


@query("patch_cells_unfit", sql="select s_suppkey, s_acctbal from supplier")
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return diff.patch_cells(df, _mixed_edits(df)[2], "s_suppkey")


@query("patch_rejected", sql="""
select s_suppkey as key, 's_acctbal' as col, 'abc' as value from supplier where s_suppkey % 6 = 0""")
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    first, second, third = _mixed_edits(df)
    return diff.rejected_edits(df, first.unionByName(second).unionByName(third)).drop("n")


@query("delete_rows_by_key", sql="""
select c.c_custkey, c_name from customer c where c_custkey not in
  (select o_custkey from orders where o_orderstatus = 'P')""")
def _(spark, sf):
    keys = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("key"))
    return diff.delete_rows(table(spark, sf, "customer"), keys, "c_custkey").select(
        "c_custkey", "c_name")
