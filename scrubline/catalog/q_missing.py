"""Queries on missing values, outliers and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apply_step
from .q_rows import FENCES
from .registry import query
from .views import table, view

EVENTS = ("dirty_events",)


def _events(key: str, tool: str, params: dict, columns: str, extra: str = "",
            rounded: bool = False) -> None:
    @query(key, uses=EVENTS, sql=f"select {columns} from dirty_events{extra}")
    def _(spark, sf):
        df = apply_step(view(spark, sf, "dirty_events"), tool, "value", params)
        return df.withColumn("value", F.round("value", 6)) if rounded else df


_MISSING = "value is null as value_missing"
_events("impute_flag_only", "impute_missing", {"strategy": "flag_only"}, f"*, {_MISSING}")
_events("impute_mean", "impute_missing", {"strategy": "mean"},
        f"* exclude (m) replace (round(coalesce(value, m), 6) as value), {_MISSING}",
        ", (select avg(value) as m from dirty_events)", rounded=True)
_events("impute_median", "impute_missing", {"strategy": "median"},
        f"* exclude (m) replace (round(coalesce(value, m), 6) as value), {_MISSING}",
        ", (select quantile_cont(value, 0.5) as m from dirty_events)", rounded=True)
_events("impute_mode", "impute_missing", {"strategy": "mode"},
        f"* exclude (m) replace (coalesce(value, m) as value), {_MISSING}",
        ", (select value as m from dirty_events where value is not null group by value "
        "order by count(*) desc, value limit 1)")
_events("impute_constant", "impute_missing", {"strategy": "constant", "value": -1.5},
        f"* replace (coalesce(value, -1.5) as value), {_MISSING}")


@query("flag_outliers_iqr", uses=EVENTS, sql=f"""
with {FENCES} select d.*, coalesce(value < lo or value > hi, false) as value_outlier
from dirty_events d, b""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "flag_outliers", "value")


@query("flag_outliers_zscore", uses=EVENTS, sql="""
select d.*, coalesce(abs((value - m) / s) > 2.5, false) as value_outlier
from dirty_events d, (select avg(value) as m, stddev_samp(value) as s from dirty_events)""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "flag_outliers", "value",
                      {"method": "zscore", "threshold": 2.5})


@query("flag_outliers_lineitem", sql="""
with b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3
  from lineitem))
select l_orderkey, l_linenumber, l_extendedprice,
  l_extendedprice < lo or l_extendedprice > hi as l_extendedprice_outlier
from lineitem, b""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return apply_step(df, "flag_outliers", "l_extendedprice")


@query("validate_rule_range", uses=EVENTS, sql="""
select *, coalesce(value < 5 or value > 500, false) as value_invalid from dirty_events""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "validate_rule", "value",
                      {"min": 5, "max": 500})


@query("validate_rule_allowed", uses=EVENTS, sql="""
select *, event_type is not null and event_type not in ('click', 'view', 'CLICK')
  as event_type_invalid from dirty_events""")
def _(spark, sf):
    return apply_step(view(spark, sf, "dirty_events"), "validate_rule", "event_type",
                      {"allowed": ["click", "view", "CLICK"]})
