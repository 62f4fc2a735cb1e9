"""Queries that inject labelled errors and score a cleaning run."""

from __future__ import annotations


from ..plans import score as S
from ..plans.inject import KeyPick, inject
from ..plans.recipe import run_recipe
from . import q_convert as C
from .q_columns import duck_fold
from .registry import query
from .views import table, view

CLEAN = ("clean_customers",)


def duck_choose(index: str, options: list[str]) -> str:
    body = " ".join(f"when {i} then {o}" for i, o in enumerate(options))
    return f"case {index} {body} end"


def duck_swap(c: str) -> str:
    low = "abcdefghijklmnopqrstuvwxyz"
    return f"translate({c}, '{low + low.upper()}', '{low.upper() + low}')"


def duck_styles(kind: str, c: str) -> list[str]:
    money = f"format('{{:,.2f}}', cast({c} as double))"
    digits = f"substr({c}, 4)"
    a, b, d = f"substr({c}, 4, 3)", f"substr({c}, 7, 3)", f"substr({c}, 10, 4)"
    day = f"cast({c} as date)"
    return {
        "dates": [f"strftime({day}, '{f}')" for f in
                  ("%m/%d/%Y", "%B %d, %Y", "%Y%m%d", "%Y/%m/%d")],
        "phones": [f"'0' || {digits}", f"'63-' || {a} || '-' || {b} || '-' || {d}",
                   f"'0' || {a} || ' ' || {b} || ' ' || {d}"],
        "currency": [f"'₱' || {money}", f"'PHP ' || replace({money}, ',', '')",
                     f"'php ' || {money}"],
        "whitespace": [f"'  ' || {c}", f"{c} || '   '",
                       f"regexp_replace({c}, '^([^ ]*) ', '\\1  ')", f"chr(9) || {c} || ' '"],
        # The upper-case original drops out of the four styles.
        "casing": [f"lower({c})", f"upper({c}[1]) || lower({c}[2:])", duck_swap(c)],
    }[kind]


def duck_inject(kind: str, c: str, key: str, shift: int, rest: str | None = None) -> str:
    n = {"dates": 4, "phones": 3, "currency": 3, "whitespace": 4, "casing": 4}[kind]
    styles = duck_styles(kind, c)
    index = f"({key} // 10) % {n}" + (f" % {len(styles)}" if kind == "casing" else "")
    return (f"case when {key} % 10 = {shift} then {duck_choose(index, styles)} "
            f"else {rest or c} end")


def _inject(key_name: str, source: str, key: str, col: str, kind: str, expr: str,
            uses: tuple[str, ...] = ()) -> None:
    @query(key_name, uses=uses, sql=f"select {key}, {expr} as {col} from {source}")
    def _(spark, sf):
        df = view(spark, sf, source) if uses else table(spark, sf, source)
        pick = KeyPick({(kind, col): 3})
        return inject(df.select(key, col), key, {kind: [col]}, pick).df


_inject("inject_dates", "orders", "o_orderkey", "o_orderdate", "dates",
        duck_inject("dates", "o_orderdate", "o_orderkey", 3,
                    "strftime(o_orderdate, '%Y-%m-%d')"))
_inject("inject_phones", "clean_customers", "customer_id", "phone", "phones",
        duck_inject("phones", "phone", "customer_id", 3), CLEAN)
_inject("inject_currency", "orders", "o_orderkey", "o_totalprice", "currency",
        duck_inject("currency", "o_totalprice", "o_orderkey", 3,
                    "cast(o_totalprice as varchar)"))
_inject("inject_casing", "customer", "c_custkey", "c_mktsegment", "casing",
        duck_inject("casing", "c_mktsegment", "c_custkey", 3))
_inject("inject_dtype", "orders", "o_orderkey", "o_custkey", "dtype",
        "case when o_orderkey % 10 = 3 then format('{:,}', o_custkey) "
        "else cast(o_custkey as varchar) end")
_inject("inject_dtype_decimal", "part", "p_partkey", "p_retailprice", "dtype",
        "case when p_partkey % 10 = 3 then ' ' || cast(p_retailprice as varchar) || ' ' "
        "else cast(p_retailprice as varchar) end")
_inject("inject_outliers", "part", "p_partkey", "p_retailprice", "outliers",
        "case when p_partkey % 10 = 3 then p_retailprice * 100 else p_retailprice end")
_inject("inject_whitespace", "part", "p_partkey", "p_name", "whitespace",
        duck_inject("whitespace", "p_name", "p_partkey", 3))
_inject("inject_nulls", "customer", "c_custkey", "c_acctbal", "nulls",
        "case when c_custkey % 10 = 3 then null else c_acctbal end")


@query("inject_duplicates", sql="""
select c_custkey, c_name from customer
union all select c_custkey, c_name from customer where c_custkey % 10 = 3""")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    pick = KeyPick({("duplicates", "c_custkey"): 3})
    return inject(df, "c_custkey", {"duplicates": ["c_custkey"]}, pick).df


KEY = "customer_id"
SHIFTS = {("dates", "signup"): 0, ("phones", "phone"): 1, ("outliers", "age"): 2,
          ("currency", "spend"): 3, ("casing", "segment"): 4, ("dtype", "points"): 5,
          ("whitespace", "full_name"): 6, ("nulls", "age"): 7, ("duplicates", KEY): 8}
SPEC: dict[str, list[str]] = {}
for _kind, _col in SHIFTS:
    SPEC.setdefault(_kind, []).append(_col)
# Phones are left alone, and one segment is changed without need, so that the
# scores are not all 0 or 1.
STEPS = [
    {"tool": t, "col": c, "params": p, "reason": "scored run"} for t, c, p in (
        ("drop_duplicates", None, {}), ("normalize_dates", "signup", {}),
        ("normalize_currency", "spend", {}), ("standardize_categories", "segment", {}),
        ("replace_values", "segment", {"find": "BUILDING", "replace": "Building"}),
        ("fix_dtypes", "points", {"target": "numeric"}), ("trim_whitespace", "full_name", {}),
        ("impute_missing", "age", {"strategy": "flag_only"}),
        ("flag_outliers", "age", {"method": "iqr"}))]

_K = "customer_id"
_DIRTY = f"""
dirty as (select customer_id, {duck_inject('phones', 'phone', _K, 1)} as phone,
  {duck_inject('dates', 'signup', _K, 0)} as signup,
  {duck_inject('whitespace', 'full_name', _K, 6)} as full_name,
  {duck_inject('casing', 'segment', _K, 4)} as segment,
  {duck_inject('currency', 'spend', _K, 3, 'cast(spend as varchar)')} as spend,
  case when {_K} % 10 = 5 then format('{{:,}}', points) else cast(points as varchar) end
    as points,
  case {_K} % 10 when 2 then age * 100 when 7 then null else age end as age
  from clean_customers)"""
_MANIFEST = "manifest as (" + " union all ".join(
    f"select '{t}' as type, '{c}' as col, cast({_K} as varchar) as key "
    f"from clean_customers where {_K} % 10 = {s}"
    for (k, c), s in SHIFTS.items()
    for t in [{"dates": "mixed_date_format", "phones": "phone_format", "outliers": "outlier",
               "currency": "currency_format", "casing": "category_casing",
               "dtype": "dtype_corruption", "whitespace": "whitespace", "nulls": "null",
               "duplicates": "duplicate"}[k]]) + ")"
_OUT = f"""
{C.duck_standard('segment', 'dirty')},
fence as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
  select quantile_cont(age, 0.25) as q1, quantile_cont(age, 0.75) as q3 from dirty)),
out as (select customer_id, phone, {C.duck_date('signup')} as signup,
  trim(regexp_replace(full_name, '\\s+', ' ', 'g')) as full_name,
  replace(coalesce(v, segment), 'BUILDING', 'Building') as segment,
  {C.duck_amount('spend')} as spend, {C.duck_number('points')} as points, age,
  age is null as age_missing, coalesce(age < lo or age > hi, false) as age_outlier
  from dirty left join canon on {duck_fold('segment')} = k, fence)"""
_COLUMNS = ["phone", "signup", "full_name", "segment", "spend", "points", "age"]
_SAME = " ".join(f"when '{c}' then o.{c} is not distinct from c.{c}" for c in _COLUMNS)
_FIXES = f"""
fixes as (select type, col, key, type <> 'phone_format' as detected,
  case type when 'duplicate' then true when 'null' then age_missing
    when 'outlier' then age_outlier else case col {_SAME} end end as fixed
  from manifest m join clean_customers c on cast(c.customer_id as varchar) = key
  join out o on o.customer_id = c.customer_id)"""
_BASE = f"with {_DIRTY}, {_MANIFEST}, {_OUT}, {_FIXES}"


def _injected(spark, sf):
    return inject(view(spark, sf, "clean_customers"), KEY, SPEC, KeyPick(SHIFTS))


def _scored_rows(spark, sf):
    clean, made = view(spark, sf, "clean_customers"), _injected(spark, sf)
    output = run_recipe(made.df, STEPS).df
    return S.aligned(clean, output, S.score_detection(made.manifest, STEPS), KEY)


@query("error_manifest", uses=CLEAN, sql=f"with {_MANIFEST} select * from manifest")
def _(spark, sf):
    return _injected(spark, sf).manifest


@query("inject_all", uses=CLEAN, sql=f"""
with {_DIRTY} select * from dirty union all select * from dirty where {_K} % 10 = 8""")
def _(spark, sf):
    return _injected(spark, sf).df


@query("score_detection", uses=CLEAN, sql=f"""
with {_MANIFEST} select *, type <> 'phone_format' as detected from manifest""")
def _(spark, sf):
    return S.score_detection(_injected(spark, sf).manifest, STEPS)


@query("score_fix", uses=CLEAN, sql=f"{_BASE} select * from fixes")
def _(spark, sf):
    return S.score_fix(_scored_rows(spark, sf))


_TOUCHED = {c: [s for (k, cc), s in SHIFTS.items() if cc == c] for c in _COLUMNS}
_CELLS = " union all ".join(
    f"select o.{c} is not distinct from c.{c} as same from clean_customers c join out o "
    f"on o.customer_id = c.customer_id where c.customer_id % 10 not in "
    f"({', '.join(map(str, shifts))})" for c, shifts in _TOUCHED.items())


@query("score_false_fix", uses=CLEAN, sql=f"""
{_BASE} select count(*) as n_clean_cells, count(*) filter (where not same) as n_false_fixes,
  round(count(*) filter (where not same) / count(*), 4) as false_fix_rate from ({_CELLS})""")
def _(spark, sf):
    return S.score_false_fix(_scored_rows(spark, sf))


@query("score_summary", uses=CLEAN, sql=f"""
{_BASE} select coalesce(type, 'overall') as type, count(*) as n,
  count(*) filter (where detected) as detected, count(*) filter (where fixed) as fixed,
  round(count(*) filter (where detected) / count(*), 4) as detection_rate,
  round(count(*) filter (where fixed) / count(*), 4) as fix_rate
from fixes group by rollup (type)""")
def _(spark, sf):
    return S.score_summary(S.score_fix(_scored_rows(spark, sf)))
