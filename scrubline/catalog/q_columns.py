"""Queries on columns, text and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply_step
from .registry import query
from .views import table, view

ORDERS, EVENTS, CUSTOMERS = ("dirty_orders",), ("dirty_events",), ("dirty_customers",)
# DuckDB's \s is ASCII only; this is the Unicode class.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def duck_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def duck_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def duck_fold(c: str) -> str:
    return f"lower({duck_strip(c)})"


@query("drop_blank_columns", uses=EVENTS, sql="select * exclude (note) from dirty_events")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "drop_blank_columns")


@query("drop_named_columns", uses=ORDERS,
       sql="select * exclude (phone, active) from dirty_orders")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "drop_blank_columns",
                      params={"columns": ["phone", "active"]})


@query("rename_snake_case", sql="""
select o_orderkey as order_id, o_custkey as cust_key, o_orderstatus as order_status,
  o_totalprice as total_price, o_orderpriority as order_id_2 from orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order ID"), F.col("o_custkey").alias("custKey"),
        F.col("o_orderstatus").alias(" Order  Status"), F.col("o_totalprice").alias("total.price"),
        F.col("o_orderpriority").alias("order_id"))
    return apply_step(df, "rename_columns")


@query("rename_mapping", sql="""
select s_suppkey as id, s_name as name, s_nationkey, s_acctbal as balance from supplier""")
def _(spark, sf):
    return apply_step(table(spark, sf, "supplier"), "rename_columns", params={
        "mapping": {"s_suppkey": "id", "s_name": "name", "s_acctbal": "balance"}})


def _text(key: str, col: str, tool: str, params: dict, expr: str,
          source: str = "dirty_orders") -> None:
    @query(key, uses=(source,), sql=f"""
select * replace ({expr} as {col}) from {source}""")
    def _(spark, sf):
        return apply_step(view(spark, sf, source), tool, col, params)


_text("replace_values_exact", "active", "replace_values",
      {"find": "true", "replace": "Y", "match_case": False},
      "case when lower(active) = 'true' then 'Y' else active end")
_text("replace_values_contains", "total", "replace_values",
      {"find": "PHP ", "replace": "$", "contains": True}, "replace(total, 'PHP ', '$')")
_text("replace_values_contains_nocase", "priority", "replace_values",
      {"find": "high", "replace": "top", "contains": True, "match_case": False},
      "regexp_replace(priority, 'high', 'top', 'gi')")
_text("replace_values_regex", "order_date", "replace_values",
      {"find": r"^(\d+)/(\d+)/(\d{4})$", "replace": r"\3-\1-\2", "regex": True},
      r"regexp_replace(order_date, '^(\d+)/(\d+)/(\d{4})$', '\3-\1-\2', 'g')")
_text("format_text_upper", "segment", "format_text", {"case": "upper"}, "upper(segment)",
      "dirty_customers")
_text("format_text_lower", "full_name", "format_text", {"case": "lower"}, "lower(full_name)",
      "dirty_customers")
_text("format_text_sentence", "email", "format_text", {"case": "sentence"},
      "upper(email[1]) || lower(email[2:])", "dirty_customers")


def duck_rewrite(c: str, pattern: str, replacement: str) -> str:
    """Replace each match ``m`` of a pattern by an expression of it."""
    return (f"list_reduce(list_transform(list_zip(string_split_regex({c}, '{pattern}'), "
            f"list_append(list_transform(regexp_extract_all({c}, '{pattern}'), "
            f"lambda m: {replacement}), '')), lambda z: z[1] || z[2]), lambda a, b: a || b)")


_TITLE = duck_rewrite("text", r"[\p{Lu}\p{Ll}\p{Lt}]+",
                      "replace(upper(m[1]), 'ẞ', 'Ss') || lower(m[2:])")


@query("format_text_title", sql=f"""
select doc_id, {_TITLE} as text from documents""")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return apply_step(df, "format_text", "text", {"case": "title"})


_text("round_numbers", "value", "round_numbers", {"decimals": 1}, "round_even(value, 1)",
      "dirty_events")
_text("round_numbers_text", "total", "round_numbers", {"decimals": 0},
      "coalesce(cast(round_even(try_cast(total as double), 0) as varchar), total)")


@query("scale_minmax", sql="""
select l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 9) as scaled
from lineitem, (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem)""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return apply_step(df, "scale_numeric", "l_extendedprice").select(
        "l_orderkey", "l_linenumber", F.round("l_extendedprice", 9).alias("scaled"))


@query("scale_zscore", uses=EVENTS, sql="""
select event_id, round((value - m) / s, 6) as score from dirty_events,
  (select avg(value) as m, stddev_samp(value) as s from dirty_events)""")
def _(spark, sf):
    df = apply_step(view(spark, sf, "dirty_events"), "scale_numeric", "value",
                    {"method": "zscore"})
    return df.select("event_id", F.round("value", 6).alias("score"))


@query("trim_whitespace", uses=("letters",), sql=f"""
select * replace (nfc_normalize({duck_collapse('text')}) as text) from letters""")
def _(spark, sf):
    return apply_step(view(spark, sf, "letters"), "trim_whitespace", "text")


@query("trim_whitespace_names", uses=CUSTOMERS, sql=f"""
select * replace (nfc_normalize({duck_collapse('full_name')}) as full_name)
from dirty_customers""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_customers"), "trim_whitespace", "full_name")
