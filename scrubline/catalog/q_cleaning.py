"""Queries that run recipes, clean automatically and follow a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.autoclean import auto_clean
from ..plans.recipe import run_recipe
from ..session import new_folder
from ..sources import write_csv
from ..streaming.feed import BY, Feed, feed_audit, feed_log, feed_rejected
from . import q_convert as C
from .q_checks import RECIPE, V2_CTES, second_version
from .q_columns import duck_fold
from .registry import query
from .views import table, view

ORDERS = ("dirty_orders",)


@query("run_recipe", uses=ORDERS, sql=f"with {V2_CTES} select * from v2")
def _(spark, sf):
    return second_version(spark, sf)


_DATE, _PHONE = C.duck_date("order_date"), C.duck_phone("phone")
_COUNTS = [
    "(select count(*) from dirty_orders where order_id is null)",
    "(select count(*) from dirty_orders where order_id is not null) "
    "- (select count(*) from clean_rows)",
    f"(select count(*) from clean_rows where {_DATE} is distinct from order_date)",
    f"(select count(*) from clean_rows where {C.duck_code('total')} is not null)",
    f"(select count(*) from clean_rows where {_PHONE} is distinct from phone)",
    "(select count(*) from clean_rows where trim(priority) <> priority)",
    f"(select count(*) from trimmed join canon on {duck_fold('priority')} = k "
    "where v <> priority)",
    f"(select count(*) from clean_rows where {C.duck_bool('active')} is not null)",
    "(select count(*) from clean_rows where qty_text is null)",
]


@query("recipe_audit", uses=ORDERS, sql=f"with {V2_CTES} " + " union all ".join(
    f"select {i} as step, '{s['tool']}' as tool, "
    f"{'null' if s['col'] is None else repr(s['col'])} as col, 'ok' as status, "
    f"{n} as rows_affected" for i, (s, n) in enumerate(zip(RECIPE, _COUNTS))))
def _(spark, sf):
    return run_recipe(view(spark, sf, "dirty_orders"), RECIPE).audit().select(
        "step", "tool", "col", "status", "rows_affected")


@query("recipe_audit_examples")
def _(spark, sf):
    """Masked before and after cells of each step, at most three."""
    audit = run_recipe(view(spark, sf, "dirty_orders"), RECIPE).audit()
    return audit.select("step", "tool", F.explode("examples").alias("e")).select(
        "step", "tool", "e.*")


_FLAGS = ", ".join(f"{c} is null as {c}_missing" for c in (
    "order_id", "order_date", "total", "phone", "priority", "active", "qty_text"))


@query("auto_clean", uses=ORDERS, sql=f"""
with {V2_CTES}, cleaned as (select * exclude (qty_text_missing)
  replace ({C.duck_number('qty_text')} as qty_text) from v2)
select *, {_FLAGS} from cleaned""")
def _(spark, sf):
    return auto_clean(view(spark, sf, "dirty_orders")).df


FEED_STEPS = [
    {"tool": t, "col": c, "params": p, "reason": "feed recipe"} for t, c, p in (
        ("trim_whitespace", "full_name", {}), ("normalize_phone", "phone", {}),
        ("standardize_categories", "segment", {}), ("standardize_categories", "full_name", {}),
        ("impute_missing", "email", {"strategy": "flag_only"}),
        ("flag_outliers", "balance", {"method": "iqr"}))]
FEED_CONTRACT = {"columns": {"balance": {"max": 20000}, "customer_id": {"unique": True}}}


CUSTOMERS = ("dirty_customers",)


def run_feed(spark, sf) -> tuple[Feed, str]:
    """Three files in a fresh folder: one the recipe fits, one with another
    schema, one that breaks the contract."""
    root = new_folder(spark, "feed")
    good = view(spark, sf, "dirty_customers")
    write_csv(good.coalesce(1), f"{root}/landing/good")
    write_csv(table(spark, sf, "supplier").coalesce(1), f"{root}/landing/other")
    write_csv(good.withColumn("balance", F.abs("balance") + 30000.0).coalesce(1), f"{root}/landing/breach")
    feed = Feed(f"{root}/landing", f"{root}/out", f"{root}/quarantine", f"{root}/log",
                f"{root}/checkpoint", FEED_STEPS, FEED_CONTRACT)
    feed.start(spark).awaitTermination()
    return feed, root


def _kind(c):
    return F.regexp_extract(c, "^(good|other|breach)", 1).alias("kind")


_TRIMMED = r"trim(regexp_replace(full_name, '\s+', ' ', 'g'))"
_FED = f"""trimmed as (select * replace ({_TRIMMED} as full_name, {C.duck_phone('phone')} as phone)
  from dirty_customers),
{C.duck_standard('segment', 'trimmed')},
bounds as (select quantile_cont(cast(balance as double), 0.25) as q1,
  quantile_cont(cast(balance as double), 0.75) as q3 from dirty_customers)"""
_FAR = "coalesce(balance < q1 - 1.5 * (q3 - q1) or balance > q3 + 1.5 * (q3 - q1), false)"


@query("clean_folder_stream", uses=CUSTOMERS, sql=f"""
with {_FED} select t.* replace (coalesce(v, segment) as segment), email is null as email_missing,
  {_FAR} as balance_outlier
from trimmed t left join canon on {duck_fold('segment')} = k, bounds""")
def _(spark, sf):
    """What came through: the cleaned rows of the files that passed."""
    feed, _root = run_feed(spark, sf)
    schema = ("customer_id bigint, full_name string, email string, phone string, segment string, "
              "balance double, email_missing boolean, balance_outlier boolean")
    return (spark.read.option("header", True).option("escape", '"').schema(schema)
            .csv(feed.out).drop(BY))


@query("quarantine_reason", uses=CUSTOMERS, sql="""
select 'good' as kind, 'cleaned' as status, cast(null as varchar) as reason, count(*) as rows
from dirty_customers
union all select 'breach', 'quarantined', 'broken rules: range of balance (n)', count(*) from dirty_customers
union all select distinct 'other', 'quarantined',
  'the steps need other columns: step n: no column ''full_name''', cast(null as bigint) from supplier""")
def _(spark, sf):
    """The feed's log, with the files counted per kind, status and reason."""
    feed, _root = run_feed(spark, sf)
    return feed_log(spark, feed.log).groupBy(
        _kind("file"), "status",
        F.regexp_replace("reason", r"\d+", "n").alias("reason")).agg(
            F.sum("rows").alias("rows"))


@query("feed_audit", uses=CUSTOMERS, sql=f"""
with {_FED} select 0 as step, 'trim_whitespace' as tool, count(*) filter (where {_TRIMMED} <> full_name)
  as rows_affected from dirty_customers
union all select 1, 'normalize_phone', count(*) filter (where {C.duck_phone('phone')} <> phone) from dirty_customers
union all select 2, 'standardize_categories', count(*) filter (where v <> segment)
  from trimmed join canon on {duck_fold('segment')} = k
union all select 3, 'standardize_categories', 0
union all select 4, 'impute_missing', count(*) filter (where email is null) from dirty_customers
union all select 5, 'flag_outliers', count(*) filter (where {_FAR}) from dirty_customers, bounds""")
def _(spark, sf):
    """What each step changed in the file that passed."""
    feed, _root = run_feed(spark, sf)
    return feed_audit(spark, feed.log).where("file like 'good%'").select("step", "tool", "rows_affected")


@query("feed_rejected", uses=CUSTOMERS, sql="""
select 'breach' as kind, cast(customer_id as bigint) as id, cast(null as varchar) as name from dirty_customers
union all select 'other', cast(s_suppkey as bigint), s_name from supplier""")
def _(spark, sf):
    """The rows of the rejected files, as they came."""
    feed, _root = run_feed(spark, sf)
    return feed_rejected(spark, feed.log).select(
        _kind("file"),
        F.coalesce(F.get_json_object("row", "$.customer_id"), F.get_json_object("row", "$.s_suppkey"))
        .cast("bigint").alias("id"), F.get_json_object("row", "$.s_name").alias("name"))
