"""Queries that filter or deduplicate rows."""

from __future__ import annotations

from ..operators import apply_step
from ..operators.rows import row_loss_table
from .registry import query
from .views import view

ORDERS = ("dirty_orders",)
EVENTS = ("dirty_events",)
ORDER_COLUMNS = ["order_id", "order_date", "total", "phone", "priority", "active", "qty_text"]
FENCES = """b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
  from dirty_events))"""


@query("drop_duplicates_full", uses=ORDERS, sql="select distinct * from dirty_orders")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_duplicates")


_rest = ", ".join(f"{c} nulls first" for c in ORDER_COLUMNS if c != "phone")


@query("drop_duplicates_subset", uses=ORDERS, sql=f"""
select * exclude (rn) from (select *, row_number() over (partition by phone
  order by {_rest}) as rn from dirty_orders) where rn = 1""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_duplicates",
                      params={"subset": ["phone"], "order_by": ["order_id"]})


_all_blank = " + ".join(
    f"(case when {c} is null then 0 else 1 end)" if c == "order_id" else
    f"(case when trim(coalesce({c}, '')) = '' then 0 else 1 end)" for c in ORDER_COLUMNS)


@query("drop_blank_rows", uses=ORDERS, sql=f"""
select * from dirty_orders where {_all_blank} >= 1""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_blank_rows")


@query("drop_blank_rows_min", uses=ORDERS, sql=f"""
select * from dirty_orders where {_all_blank} >= 6""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_blank_rows",
                      params={"min_non_null": 6})


@query("drop_blank_rows_col", uses=ORDERS, sql="""
select * from dirty_orders where trim(coalesce(qty_text, '')) <> ''""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_blank_rows", "qty_text")


def _where(key: str, col: str, params: dict, condition: str) -> None:
    @query(key, uses=ORDERS, sql=f"""
select * from dirty_orders where not coalesce({condition}, false)""")
    def _(spark, sf):
        return apply_step(view(spark, sf, "dirty_orders"), "drop_rows_where", col, params)


_where("drop_rows_where_equals", "active", {"equals": "yes"}, "active = 'yes'")
_where("drop_rows_where_equals_nocase", "priority", {"equals": "5-low", "match_case": False},
       "lower(priority) = '5-low'")
_where("drop_rows_where_contains", "priority", {"contains": "HIGH"},
       "contains(priority, 'HIGH')")
_where("drop_rows_where_regex", "order_date", {"regex": r"^\d{4}/\d+"},
       r"regexp_matches(order_date, '^\d{4}/\d+')")
_where("drop_rows_where_null", "active", {"is_null": True}, "active is null")
_where("drop_rows_where_range", "order_id", {"min": 1000, "max": 12000},
       "order_id < 1000 or order_id > 12000")
_where("drop_rows_where_range_text", "total", {"max": 150000.0},
       "try_cast(total as double) > 150000")


@query("keep_rows_where", uses=ORDERS, sql="""
select * from dirty_orders where contains(lower(priority), 'urgent')""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_rows_where", "priority",
                      {"contains": "urgent", "match_case": False, "keep": True})


@query("drop_outliers", uses=EVENTS, sql=f"""
with {FENCES} select d.* from dirty_events d, b
where not coalesce(value < lo or value > hi, false)""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "flag_outliers", "value",
                      {"action": "drop"})


@query("row_loss_guard", uses=ORDERS, sql="""
select n_before, n_after, round((n_before - n_after) / n_before, 6) as loss,
  case when n_after = 0 then 'refused' when (n_before - n_after) / n_before >= 0.5
    then 'warning' else 'ok' end as verdict
from (select count(*) as n_before,
  count(*) filter (where not coalesce(order_id > 3000, false)) as n_after from dirty_orders)""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    return row_loss_table(df, apply_step(df, "drop_rows_where", "order_id", {"max": 3000}))
