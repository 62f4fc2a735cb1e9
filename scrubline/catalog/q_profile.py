"""Queries on the profile, its issues and the suggested steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells
from ..operators.rows import filled_cells
from ..plans import columnstats, profile, suggest
from . import duck_profile as D
from .q_columns import duck_fold
from .registry import query
from .views import table, view

ORDERS, EVENTS = ("dirty_orders",), ("dirty_events",)
OC, EC = D.ORDERS_COLUMNS, D.EVENTS_COLUMNS


def _pick(rows: list[str], *signals: str) -> str:
    wanted = ", ".join(f"'{s}'" for s in signals)
    return (f"select col, signal, detail, value from ({' union all '.join(rows)}) "
            f"where signal in ({wanted})")


def _only(df, *signals: str):
    return df.filter(F.col("signal").isin(*signals)).select("col", "signal", "detail", "value")


@query("profile_shape", uses=ORDERS, sql="""
select cast(count(*) as double) as n_rows, 7 as n_cols from dirty_orders""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    return df.agg(F.count(F.lit(1)).cast("double").alias("n_rows"),
                  F.lit(len(df.columns)).alias("n_cols"))


@query("profile_dtypes", uses=ORDERS, sql=" union all ".join(
    f"select '{c}' as col, '{k}' as kind, {i} as place from (select 1)"
    for i, (c, k) in enumerate(OC.items())))
def _(spark, sf):
    rows = [r for r in profile.column_rows(view(spark, sf, "dirty_orders")) if r[1] == "dtype"]
    df = profile.small_table(spark, rows, profile.SCHEMA)
    return df.select("col", F.col("detail").alias("kind"), F.col("value").cast("int").alias("place"))


@query("profile_nulls", uses=ORDERS, sql=_pick(D.table_rows("dirty_orders", OC),
                                               "null_pct", "n_filled"))
def _(spark, sf):
    return _only(profile.table_signals(view(spark, sf, "dirty_orders")), "null_pct", "n_filled")


@query("profile_distinct", uses=ORDERS,
       sql=_pick(D.distinct_rows("dirty_orders", OC), "n_unique"))
def _(spark, sf):
    freq = profile.value_frequencies(view(spark, sf, "dirty_orders"))
    return profile.distinct_counts(freq).selectExpr(
        "col", "'n_unique' as signal", "cast(null as string) as detail",
        "cast(n_unique as double) as value")


@query("profile_numeric_stats", uses=EVENTS,
       sql=_pick(D.number_rows("dirty_events", EC), "min", "max", "mean", "std"))
def _(spark, sf):
    return _only(profile.number_signals(view(spark, sf, "dirty_events")),
                 "min", "max", "mean", "std")


def _outliers(df, columns):
    return profile.outlier_counts(df, columns).select(
        "col", F.lit("iqr_outliers").alias("signal"), F.lit(None).cast("string").alias("detail"),
        F.col("n").cast("double").alias("value"))


_LINES = {c: "number" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")}


@query("profile_outliers", uses=EVENTS, sql=_pick(
    D.outlier_rows("dirty_events", {c: k for c, k in EC.items() if k == "number"})
    + D.outlier_rows("lineitem", _LINES), "iqr_outliers"))
def _(spark, sf):
    events, lines = view(spark, sf, "dirty_events"), table(spark, sf, "lineitem")
    numbers = [c for c, k in EC.items() if k == "number"]
    return _outliers(events, {c: F.col(c).cast("double") for c in numbers}).unionByName(
        _outliers(lines, {c: F.col(c) for c in _LINES}))


_PRICES = """(select replace(format('{:,.2f}', value * 3), '.00', '') as price
  from events)"""


@query("profile_outliers_text", sql=_pick(D.outlier_rows("prices", {"price": "text"}),
                                          "iqr_outliers").replace(
    "from prices", f"from {_PRICES}"))
def _(spark, sf):
    df = table(spark, sf, "events").select(
        F.replace(F.format_number(F.col("value") * 3, 2), F.lit(".00"), F.lit(""))
        .alias("price"))
    likely = profile.text_signals(df).filter("signal = 'number_like'").collect()
    return _outliers(df, {r["col"]: cells.grouped_text_to_number(F.col(r["col"]))
                          for r in likely})


def _text(key: str, *signals: str, source: str = "dirty_orders", columns=None) -> None:
    @query(key, uses=(source,), sql=_pick(D.text_rows(source, columns or OC), *signals))
    def _(spark, sf):
        return _only(profile.text_signals(view(spark, sf, source)), *signals)


_text("profile_date_formats", "date_format")
_text("profile_phone_formats", "phone_format")
_text("profile_currency", "currency_like")
_text("profile_numeric_as_string", "numeric_as_string")
_text("profile_bool_as_string", "bool_as_string")
_text("profile_whitespace", "whitespace", source="dirty_customers",
      columns=D.CUSTOMERS_COLUMNS)
_text("profile_whitespace_orders", "whitespace")


@query("profile_non_nfc", uses=("letters",), sql="""
select 'text' as col, 'non_nfc' as signal, cast(null as varchar) as detail,
  cast(count(*) as double) as value from letters where nfc_normalize(text) <> text""")
def _(spark, sf):
    return _only(profile.nfc_signals(view(spark, sf, "letters")), "non_nfc")


@query("profile_casing_variants", uses=ORDERS, sql=f"""
select r.col, r.value as raw, f.value as folded
from ({_pick(D.distinct_rows('dirty_orders', OC), 'casing_raw')}) r
join ({_pick(D.distinct_rows('dirty_orders', OC), 'casing_folded')}) f on r.col = f.col""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    texts = [n for n, k in cells.kinds(df).items() if k == "text"]
    counts = profile.distinct_counts(profile.value_frequencies(df.select(*texts)))
    rows = df.agg(F.count(F.lit(1))).scalar()
    low = F.col("n_unique") <= F.greatest(F.lit(20), F.floor(F.col("rows") / 20))
    return (counts.withColumn("rows", rows).filter(low & (F.col("folded") < F.col("n_unique")))
            .select("col", F.col("n_unique").cast("double").alias("raw"),
                    F.col("folded").cast("double").alias("folded")))


_SPELLINGS = " union all ".join(
    f"select '{c}' as col, cast(count(distinct {c}) as double) as raw, "
    f"cast(count(distinct {duck_fold(c)}) as double) as folded from dirty_customers"
    for c in ("full_name", "email", "phone", "segment"))


@query("profile_casing_all", uses=("dirty_customers",), sql=f"select * from ({_SPELLINGS}) where folded < raw")
def _(spark, sf):
    """Spellings of every text column, however many values it has."""
    found = profile.profile(view(spark, sf, "dirty_customers"), limits=profile.Limits(casing_values=None))
    value = F.col("value")
    return found.where("signal in ('casing_raw', 'casing_folded')").groupBy("col").agg(
        F.max(F.when(F.col("signal") == "casing_raw", value)).alias("raw"),
        F.max(F.when(F.col("signal") == "casing_folded", value)).alias("folded"))


def _top(c: str, masked: str) -> str:
    return (f"select '{c}' as col, rank, n, {masked} as value from (select x, n, "
            f"cast(row_number() over (order by n desc, x) as integer) as rank from "
            f"(select {c} as x, count(*) as n from dirty_orders where {c} is not null "
            f"group by 1)) where rank <= 5")


_WHOLE = "case when length(x) <= 2 then repeat('*', length(x)) else left(x, 1) || " \
    "repeat('*', least(length(x) - 2, 8)) || right(x, 1) end"


@query("profile_top_values", uses=ORDERS, sql=" union all ".join([
    _top("priority", "x"), _top("active", "x"), _top("qty_text", "x"), _top("phone", _WHOLE),
    _top("order_date", r"regexp_replace(x, '^(\d\d)\d{6}$', '\1******')"), _top("total", "x")]))
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    return profile.top_values(df, profile.value_frequencies(df), df.columns)


@query("profile_bad_names", sql="""
select unnest(['Order ID', 'custKey', ' Order  Status', 'o_totalprice%'])  as col""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumnsRenamed({
        "o_orderkey": "Order ID", "o_custkey": "custKey", "o_orderstatus": " Order  Status",
        "o_totalprice": "o_totalprice%"})
    rows = [r for r in profile.column_rows(df) if r[1] == "bad_name"]
    return profile.small_table(spark, rows, profile.SCHEMA).select("col")


@query("profile_dup_rows", uses=ORDERS, sql="""
select (select count(*) from dirty_orders)
  - (select count(*) from (select distinct * from dirty_orders)) as n""")
def _(spark, sf):
    return profile.duplicate_rows(view(spark, sf, "dirty_orders"))


@query("profile_dup_keys", uses=ORDERS, sql=f"""
select col, cast(value as bigint) as n from (
  {' union all '.join(D.duplicate_key_rows('dirty_orders', OC))})""")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    keys = df.select("order_id")
    return profile.duplicate_keys(keys, profile.distinct_counts(profile.value_frequencies(keys)),
                                  profile.table_signals(keys))


@query("profile_blank_rows", uses=ORDERS,
       sql="select count(*) as blank_rows from dirty_orders where order_id is null")
def _(spark, sf):
    df = view(spark, sf, "dirty_orders")
    return df.agg(F.count_if(filled_cells(df) == 0).alias("blank_rows"))


@query("profile_blank_columns", uses=EVENTS, sql=_pick(
    D.table_rows("dirty_events", EC), "blank_column") + " and value > 0")
def _(spark, sf):
    return _only(profile.table_signals(view(spark, sf, "dirty_events")),
                 "blank_column").filter("value > 0")


def _share(a: str, b: str) -> str:
    return f"coalesce(round(100.0::double * ({a}) / nullif({b}, 0), 1), 0)"


@query("column_stats", uses=EVENTS, sql=f"""
select 'value' as col, n, n - f as nulls, {_share('n - f', 'n')} as null_pct, u as unique,
  {_share('u', 'f')} as unique_pct, {_share('f', 'n')} as fill_pct, round(lo, 4) as min,
  round(hi, 4) as max, round(m, 4) as mean, round(md, 4) as median, round(s, 4) as std,
  round(q1, 4) as q1, round(q3, 4) as q3
from (select count(*) as n, count(value) as f, count(distinct value) as u, min(value) as lo,
  max(value) as hi, avg(value) as m, quantile_cont(value, 0.5) as md,
  stddev_samp(value) as s, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
  from dirty_events)""")
def _(spark, sf):
    return columnstats.column_stats(view(spark, sf, "dirty_events"), "value")


@query("column_stats_text", uses=ORDERS, sql=f"""
select 'priority' as col, n, n - f as nulls, {_share('n - f', 'n')} as null_pct, u as unique,
  {_share('u', 'f')} as unique_pct, {_share('f', 'n')} as fill_pct, cast(null as double) as min,
  cast(null as double) as max, cast(null as double) as mean, cast(null as double) as median,
  cast(null as double) as std, cast(null as double) as q1, cast(null as double) as q3
from (select count(*) as n, count(priority) as f, count(distinct priority) as u
  from dirty_orders)""")
def _(spark, sf):
    return columnstats.column_stats(view(spark, sf, "dirty_orders"), "priority")


@query("column_histogram", sql="""
with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem),
h as (select cast(greatest(1, least(10, ceil((l_extendedprice - lo) / ((hi - lo) / 10))))
  as bigint) as bin, count(*) as n from lineitem, s group by 1)
select b.bin, round(lo + (b.bin - 1) * ((hi - lo) / 10), 6) as low,
  round(lo + b.bin * ((hi - lo) / 10), 6) as high, coalesce(n, 0) as n
from (select unnest(range(1, 11)) as bin) b, s left join h on h.bin = b.bin""")
def _(spark, sf):
    df = columnstats.column_histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return df.withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("column_top_values", uses=ORDERS, sql="""
select priority as value, count(*) as n, round(100.0::double * count(*) /
  (select count(priority) from dirty_orders), 1) as pct
from dirty_orders where priority is not null group by 1 order by n desc, 1 limit 8""")
def _(spark, sf):
    return columnstats.column_top_values(view(spark, sf, "dirty_orders"), "priority")


def _with_profile(source: str, columns: dict[str, str], body: str) -> str:
    return (f"with {D.profile_cte('p', source, columns)}, {D.by_column_cte('c', 'p')}, "
            f"{D.by_table_cte('t', 'p')} {body}")


@query("issue_list", uses=ORDERS,
       sql=_with_profile("dirty_orders", OC, D.issues_sql("c", "t")))
def _(spark, sf):
    return suggest.issue_list(profile.profile(view(spark, sf, "dirty_orders")))


@query("issue_list_events", uses=EVENTS,
       sql=_with_profile("dirty_events", EC, D.issues_sql("c", "t")))
def _(spark, sf):
    return suggest.issue_list(profile.profile(view(spark, sf, "dirty_events")))


_STEPS = ("select cast(row_number() over (order by place, rank) as integer) as ord, tool, col, "
          "params, reason from ({})")


@query("suggest_steps", uses=ORDERS,
       sql=_with_profile("dirty_orders", OC, _STEPS.format(D.steps_sql("c", "t"))))
def _(spark, sf):
    return suggest.suggest_steps(profile.profile(view(spark, sf, "dirty_orders")))


@query("suggest_steps_scoped", uses=EVENTS, sql=_with_profile(
    "dirty_events", EC, _STEPS.format(
        f"select * from ({D.steps_sql('c', 't')}) where col is null or col = 'value'")))
def _(spark, sf):
    return suggest.suggest_steps(profile.profile(view(spark, sf, "dirty_events")), ["value"])


@query("profile_full", uses=ORDERS, sql=f"""
with {D.profile_cte('p', 'dirty_orders', OC)}
select col, signal, detail, value from p where signal not in ('place')
  and (value <> 0 or signal in ('n_rows', 'n_cols', 'null_pct', 'n_filled', 'n_unique',
                                'min', 'max', 'mean', 'std'))
union all select * from ({' union all '.join(D.duplicate_key_rows('dirty_orders', OC))})""")
def _(spark, sf):
    df = profile.profile(view(spark, sf, "dirty_orders"))
    return df.filter("signal not in ('dtype', 'clean_name', 'top_value')").select(
        "col", "signal", "detail", "value")
