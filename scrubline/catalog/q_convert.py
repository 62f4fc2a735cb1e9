"""Queries that standardise or convert a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply_step
from ..operators.categories import category_codes, decode_categories
from ..plans.recipe import run_recipe
from .q_columns import duck_fold, duck_strip
from .registry import query
from .views import view

ORDERS = ("dirty_orders",)
DATE_LIST = "['%Y-%m-%d', '%m/%d/%Y', '%B %d, %Y', '%Y%m%d', '%Y/%m/%d']"


def duck_date(c: str) -> str:
    return f"coalesce(strftime(try_strptime(trim({c}), {DATE_LIST}), '%Y-%m-%d'), {c})"


def duck_phone(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return (f"case when starts_with({d}, '09') and length({d}) = 11 then '+63' || {d}[2:] "
            f"when starts_with({d}, '639') and length({d}) = 12 then '+' || {d} "
            f"when starts_with({d}, '9') and length({d}) = 10 then '+63' || {d} "
            f"else {c} end")


_MONEY = r"^(₱|PHP|Php|php|\$|USD)?\s*(-?[\d,]+(?:\.\d+)?)$"


def duck_amount(c: str) -> str:
    return f"try_cast(replace(regexp_extract(trim({c}), '{_MONEY}', 2), ',', '') as double)"


def duck_code(c: str) -> str:
    sign = f"regexp_extract(trim({c}), '{_MONEY}', 1)"
    return (f"case when regexp_matches(trim({c}), '{_MONEY}') then case {sign} "
            f"when '$' then 'USD' when '₱' then 'PHP' when '' then 'PHP' "
            f"else upper({sign}) end end")


def duck_number(c: str) -> str:
    return f"try_cast(replace(trim({c}), ',', '') as double)"


def duck_bool(c: str) -> str:
    w = f"lower(trim({c}))"
    return (f"case when {w} in ('true','yes','y','t','1') then true "
            f"when {w} in ('false','no','n','f','0') then false end")


def duck_standard(c: str, source: str) -> str:
    """CTE ``canon(k, v)``: folded value and its most frequent spelling."""
    return (f"canon as (select k, {duck_strip('s')} as v from (select s, k, row_number() over "
            f"(partition by k order by n desc, s) as rn from (select {c} as s, "
            f"{duck_fold(c)} as k, count(*) as n from {source} where {c} is not null "
            f"group by all)) where rn = 1)")


def _convert(key: str, col: str, tool: str, params: dict, columns: str) -> None:
    @query(key, uses=ORDERS, sql=f"select {columns} from dirty_orders")
    def _(spark, sf):
        return apply_step(view(spark, sf, "dirty_orders"), tool, col, params)


_convert("normalize_dates", "order_date", "normalize_dates", {},
         f"* replace ({duck_date('order_date')} as order_date)")
_convert("normalize_phone", "phone", "normalize_phone", {},
         f"* replace ({duck_phone('phone')} as phone)")
_convert("normalize_currency", "total", "normalize_currency", {},
         f"* replace ({duck_amount('total')} as total), {duck_code('total')} as total_currency")
_convert("fix_dtypes_numeric", "qty_text", "fix_dtypes", {"target": "numeric"},
         f"* replace ({duck_number('qty_text')} as qty_text)")
_convert("fix_dtypes_bool", "active", "fix_dtypes", {"target": "bool"},
         f"* replace ({duck_bool('active')} as active)")
_convert("fix_dtypes_bool_int", "active", "fix_dtypes", {"target": "bool", "as_int": True},
         f"* replace (cast({duck_bool('active')} as integer) as active)")


@query("normalize_dates_dayfirst", uses=ORDERS, sql="""
select order_id, coalesce(strftime(coalesce(
    try_strptime(order_date, ['%Y-%m-%d', '%d/%m/%Y', '%B %d, %Y', '%Y%m%d', '%Y/%m/%d']),
    try_strptime(order_date, '%m/%d/%Y')), '%Y-%m-%d'), order_date) as order_date
from dirty_orders""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders").select("order_id", "order_date")
    return apply_step(df, "normalize_dates", "order_date", {"dayfirst": True})


#: Spellings that the rows of ``orders`` are dealt to: Spark's pattern, DuckDB's.
SPELLINGS = [("MM/dd/yy", "%m/%d/%y"), ("MMM d, yy", "%b %-d, %y"), ("EEE d MMM yyyy", "%a %-d %b %Y"),
             ("EEEE, MMMM d, yyyy", "%A, %B %-d, %Y"), ("d-MMM-yy", "%-d-%b-%y")]


@query("normalize_dates_spellings", sql=f"""
select o_orderkey, case o_orderkey % {len(SPELLINGS)}
    {" ".join(f"when {i} then strftime(o_orderdate, '{duck}')" for i, (_, duck) in enumerate(SPELLINGS))} end as spelled,
  strftime(o_orderdate, '%Y-%m-%d') as day from orders""")
def _(spark, sf):
    """Every order's date in one of five spellings, and what is read from it."""
    spelled = None
    for i, (form, _duck) in enumerate(SPELLINGS):
        hit, text = F.col("o_orderkey") % len(SPELLINGS) == i, F.date_format("o_orderdate", form)
        spelled = F.when(hit, text) if spelled is None else spelled.when(hit, text)
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    df = orders.select("o_orderkey", spelled.alias("spelled")).withColumn("day", F.col("spelled"))
    return apply_step(df, "normalize_dates", "day")


@query("standardize_categories_auto", uses=ORDERS, sql=f"""
with {duck_standard('priority', 'dirty_orders')}
select d.* replace (coalesce(v, priority) as priority) from dirty_orders d
left join canon on {duck_fold('priority')} = k""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "standardize_categories", "priority")


@query("standardize_categories_wide", sql=f"""
with {duck_standard('text', 'documents')}
select doc_id, coalesce(v, text) as text from documents
left join canon on {duck_fold('text')} = k""")
def _(spark, sf):
    """A column with about as many values as rows: the mapping is not small."""
    from .views import table
    df = table(spark, sf, "documents").select("doc_id", "text")
    return apply_step(df, "standardize_categories", "text")


@query("standardize_categories_map", uses=ORDERS, sql="""
select * replace (case priority when '1-URGENT' then 'urgent' when '5-LOW' then 'low'
  when '5-low' then 'low' else priority end as priority) from dirty_orders""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_orders"), "standardize_categories", "priority",
                      {"mapping": {"1-URGENT": "urgent", "5-LOW": "low", "5-low": "low"}})


def _codes(order: str, start: int = 1) -> str:
    return (f"codes as (select priority as k, row_number() over (order by {order}) "
            f"+ {start - 1} as v from (select priority, count(*) as n, "
            f"min(order_id) as first from dirty_orders where priority is not null "
            f"group by priority))")


def _encode(key: str, order: str, params: dict, columns: str, start: int = 1) -> None:
    @query(key, uses=ORDERS, sql=f"""
with {_codes(order, start)} select {columns} from dirty_orders d left join codes
on priority = k""")
    def _(spark, sf):
        return apply_step(view(spark, sf, "dirty_orders"), "encode_categories", "priority",
                          params)


_encode("encode_categories_sorted", "priority", {}, "d.* replace (v as priority)")
_encode("encode_categories_frequency", "n desc, priority", {"order": "frequency"},
        "d.* replace (v as priority)")
_encode("encode_categories_appearance", "first, priority",
        {"order": "appearance", "order_by": "order_id"}, "d.* replace (v as priority)")
_encode("encode_new_column", "priority", {"new_column": True, "start": 0},
        "d.*, v as priority_code", start=0)


@query("encode_categories_wide", uses=ORDERS, sql="""
select order_id, dense_rank() over (order by total) as total_code
from dirty_orders where total is not null
union all select order_id, null from dirty_orders where total is null""")
def _(spark, sf):
    """Codes for a column with many values, numbered without a global sort and
    joined by shuffle."""
    df = view(spark, sf, "dirty_orders").select("order_id", "total")
    return apply_step(df, "encode_categories", "total", {"new_column": True}).select(
        "order_id", "total_code")


@query("encode_audit", uses=ORDERS, sql="""
select total as k, dense_rank() over (order by total) as v, count(*) as n,
       count(*) over () as n_categories
from dirty_orders where total is not null group by total""")
def _(spark, sf):
    """The written mapping that an audit names, and the count it gives."""
    run = run_recipe(view(spark, sf, "dirty_orders").select("total"),
                     [{"tool": "encode_categories", "col": "total"}])
    stats = run.audit().first()["stats"]
    return spark.read.parquet(stats["mapping_table"]).withColumn(
        "n_categories", F.lit(int(stats["n_categories"])).cast("bigint"))


@query("encode_decode", uses=ORDERS, sql="""
select order_id, priority, priority as decoded from dirty_orders""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders").select("order_id", "priority")
    lookup = category_codes(df, "priority")
    coded = apply_step(df, "encode_categories", "priority", {"new_column": True},
                       fitted={"lookup": lookup})
    return decode_categories(coded, "priority_code", lookup, "decoded").select(
        "order_id", F.col("priority"), "decoded")
