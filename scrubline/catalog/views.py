"""Dirty versions of the given tables, by key arithmetic only.

Each is written once for Spark and once as DuckDB SQL; both give the same
cells, so results on top of them can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_D9 = "lpad(cast(o_custkey as {S}), 9, '0')"

_SHARED_ORDERS = f"""
  case when o_custkey % 89 = 0 then '12345' else case o_custkey % 4
    when 0 then '09' || {_D9}
    when 1 then '+639' || {_D9}
    when 2 then '63-9' || substr({_D9}, 1, 2) || '-' || substr({_D9}, 3, 3)
         || '-' || substr({_D9}, 6, 4)
    else '09' || substr({_D9}, 1, 2) || ' ' || substr({_D9}, 3, 3)
         || ' ' || substr({_D9}, 6, 4) end end as phone,
  case o_orderkey % 6 when 0 then upper(o_orderpriority) when 1 then lower(o_orderpriority)
    when 2 then '  ' || o_orderpriority when 3 then o_orderpriority || '   '
    else o_orderpriority end as priority,
  case o_orderkey % 5 when 0 then 'yes' when 1 then 'No' when 2 then 'TRUE' when 3 then 'f'
    else null end as active
"""

_ORDERS = {
    "spark": """
  case when o_orderkey % 97 = 0 then 'not a date' else case o_orderkey % 5
    when 0 then date_format(o_orderdate, 'yyyy-MM-dd')
    when 1 then date_format(o_orderdate, 'MM/dd/yyyy')
    when 2 then date_format(o_orderdate, 'MMMM d, yyyy')
    when 3 then date_format(o_orderdate, 'yyyyMMdd')
    else date_format(o_orderdate, 'yyyy/MM/dd') end end as order_date,
  case when o_orderkey % 101 = 0 then 'oops' else case o_orderkey % 4
    when 0 then '₱' || format_number(o_totalprice, 2)
    when 1 then 'PHP ' || replace(format_number(o_totalprice, 2), ',', '')
    else replace(format_number(o_totalprice, 2), ',', '') end end as total,
""",
    "duckdb": """
  case when o_orderkey % 97 = 0 then 'not a date' else case o_orderkey % 5
    when 0 then strftime(o_orderdate, '%Y-%m-%d')
    when 1 then strftime(o_orderdate, '%m/%d/%Y')
    when 2 then strftime(o_orderdate, '%B %-d, %Y')
    when 3 then strftime(o_orderdate, '%Y%m%d')
    else strftime(o_orderdate, '%Y/%m/%d') end end as order_date,
  case when o_orderkey % 101 = 0 then 'oops' else case o_orderkey % 4
    when 0 then '₱' || format('{:,.2f}', o_totalprice)
    when 1 then 'PHP ' || format('{:.2f}', o_totalprice)
    else format('{:.2f}', o_totalprice) end end as total,
""",
}
_QTY = {
    "spark": "format_number(o_custkey * 37, 0)",
    "duckdb": "format('{:,}', o_custkey * 37)",
}


def _orders_rows(engine: str) -> str:
    text = "string" if engine == "spark" else "varchar"
    return (f"select o_orderkey as order_id, {_ORDERS[engine]} "
            f"{_SHARED_ORDERS.replace('{S}', text)}, "
            f"case when o_custkey % 103 = 0 then 'bad' when o_custkey % 13 = 0 then null "
            f"else {_QTY[engine]} end as qty_text from orders")


_BLANK = ("select cast(null as bigint), cast(null as {S}), cast(null as {S}), "
          "cast(null as {S}), cast(null as {S}), cast(null as {S}), cast(null as {S}) "
          "from orders where o_orderkey % 500 = 0")


def _dirty_orders_sql(engine: str) -> str:
    rows, text = _orders_rows(engine), "string" if engine == "spark" else "varchar"
    return (f"{rows} union all {rows} where o_orderkey % 50 = 0 "
            f"union all {_BLANK.replace('{S}', text)}")


_EVENTS = """
select event_id, {TS} as ts, user_id,
 case event_id % 4 when 0 then upper(event_type) when 1 then ' ' || event_type
   else event_type end as event_type,
 case when event_id % 17 = 0 then null when event_id % 53 = 0 then value * 100
   else value end as value,
 cast(null as {S}) as note from events
"""

_CUSTOMERS = """
select c_custkey as customer_id,
 case c_custkey % 4 when 0 then '  ' || full_name when 1 then full_name || '   '
   when 2 then replace(full_name, ' ', '  ') else full_name end as full_name,
 case when c_custkey % 19 = 0 then null
   else lower(replace(c_name, '#', '.')) || '@mail.example.com' end as email,
 case c_custkey % 4 when 0 then '09' || d9 when 1 then '+639' || d9
   when 2 then '63-9' || substr(d9, 1, 2) || '-' || substr(d9, 3, 3) || '-' || substr(d9, 6, 4)
   else '09' || substr(d9, 1, 2) || ' ' || substr(d9, 3, 3) || ' ' || substr(d9, 6, 4)
   end as phone,
 case c_custkey % 3 when 0 then lower(c_mktsegment) when 1 then c_mktsegment
   else substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2)) end as segment,
 c_acctbal as balance
 from (select *, lpad(cast(c_custkey as {S}), 9, '0') as d9,
  case c_custkey % 7 when 0 then 'Ana' when 1 then 'Ben' when 2 then 'Carla'
   when 3 then 'Diego' when 4 then 'Eva' when 5 then 'Gio' else 'Mia' end || ' ' ||
  case c_custkey % 11 when 0 then 'Cruz' when 1 then 'Reyes' when 2 then 'Lim'
   when 3 then 'Tan' when 4 then 'Santos' when 5 then 'Uy' when 6 then 'Ong'
   when 7 then 'Chua' when 8 then 'Lao' when 9 then 'Torres'
   else 'Bautista' end as full_name from customer) x
"""

# Documents with every third one in decomposed Unicode and with wide blanks.
_LETTERS = """
select doc_id, case when doc_id % 3 = 0
  then replace(replace(text, 'é', 'e' || {C}(769)), ' ', '  ') else text end as text,
  lang from documents
"""

# Clean customer records for the error-injection loop.
_CLEAN = """
select c_custkey as customer_id,
  '+639' || lpad(cast(c_custkey as {S}), 9, '0') as phone,
  {DAY} as signup,
  case c_custkey % 7 when 0 then 'Ana' when 1 then 'Ben' when 2 then 'Carla'
    when 3 then 'Diego' when 4 then 'Eva' when 5 then 'Gio' else 'Mia' end || ' Santos'
    as full_name,
  c_mktsegment as segment,
  cast(abs(c_acctbal) as double) as spend,
  c_custkey * 37 % 90000 + 1000 as points,
  cast(c_custkey % 60 + 20 as double) as age
from customer
"""

_SPARK = {
    "dirty_orders": ("orders", _dirty_orders_sql("spark")),
    "dirty_events": ("events", _EVENTS.replace("{S}", "string").replace(
        "{TS}", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')")),
    "dirty_customers": ("customer", _CUSTOMERS.replace("{S}", "string")),
    "letters": ("documents", _LETTERS.replace("{C}", "char")),
    "clean_customers": ("customer", _CLEAN.replace("{S}", "string").replace(
        "{DAY}", "date_format(date_add(date'2020-01-01', cast(c_custkey % 1500 as int)), "
                 "'yyyy-MM-dd')")),
}
DUCKDB = {
    "dirty_orders": _dirty_orders_sql("duckdb"),
    "dirty_events": _EVENTS.replace("{S}", "varchar").replace(
        "{TS}", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "dirty_customers": _CUSTOMERS.replace("{S}", "varchar"),
    "letters": _LETTERS.replace("{C}", "chr"),
    "clean_customers": _CLEAN.replace("{S}", "varchar").replace(
        "{DAY}", "strftime(date '2020-01-01' + cast(c_custkey % 1500 as integer), '%Y-%m-%d')"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A dirty view as a DataFrame; no name is registered in the session."""
    base, text = _SPARK[name]
    if name == "letters":
        text = text.replace("char(769)", "'́'")
    return spark.sql(text.replace(f"from {base}", "from {src}"),
                     src=table(spark, sf_dir, base))


def with_views(sql: str, uses: tuple[str, ...]) -> str:
    """The SQL with the views it uses in front of it."""
    ctes = ", ".join(f"{u} as ({DUCKDB[u]})" for u in uses)
    if not uses:
        return sql
    if sql.lstrip().lower().startswith("with "):
        return f"with {ctes}, {sql.lstrip()[5:]}"
    return f"with {ctes} {sql}"
