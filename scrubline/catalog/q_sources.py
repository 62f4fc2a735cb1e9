"""Queries that read and write tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..plans.profile import table_signals
from ..session import new_folder
from ..sources import (dedupe_column_names, for_each_table, read_csv, read_parquet,
                       read_table, write_cleaned, write_csv)
from .registry import query
from .views import table, view

CUSTOMERS = ("dirty_customers",)
TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@query("read_csv_table", uses=CUSTOMERS, sql="select * from dirty_customers")
def _(spark, sf):
    path = new_folder(spark, "csv") + ".csv"
    write_csv(view(spark, sf, "dirty_customers"), path)
    return read_csv(spark, path)


@query("read_csv_text", sql=f"""
select doc_id, case when text in ({", ".join(f"'{w}'" for w in P.NULL_WORDS)}) then null else text end as text
from documents""")
def _(spark, sf):
    """Long texts with quotes and line breaks, there and back."""
    path = new_folder(spark, "csv") + ".csv"
    write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return read_csv(spark, path)


@query("read_parquet_table", sql="select * from part")
def _(spark, sf):
    return read_parquet(spark, f"{sf}/part.parquet")


@query("read_named_table", sql="select * from supplier")
def _(spark, sf):
    table(spark, sf, "supplier").createOrReplaceTempView("scrubline_supplier")
    return read_table(spark, table="scrubline_supplier")


@query("profile_all_tables", sql=" union all ".join(
    f"select '{t}' as table_name, '{c}' as col, cast(count({c}) as double) as n_filled, "
    f"coalesce(round(100.0::double * (1 - count({c}) / nullif(count(*), 0)::double), 2), 0) "
    f"as null_pct from {t}" for t, columns in TABLES.items() for c in columns))
def _(spark, sf):
    rows, failed = for_each_table({t: table(spark, sf, t) for t in TABLES}, table_signals)
    if failed:
        raise ValueError(str(failed))
    wanted = rows.filter(F.col("signal").isin("n_filled", "null_pct"))
    return wanted.groupBy("table_name", "col").agg(
        F.max(F.when(F.col("signal") == "n_filled", F.col("value"))).alias("n_filled"),
        F.max(F.when(F.col("signal") == "null_pct", F.col("value"))).alias("null_pct"))


@query("dedupe_column_names", sql="""
select o_orderkey as a, o_custkey as a_2, o_orderstatus as b, o_totalprice as a_3
from orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("a"),
        F.col("o_orderstatus").alias("b"), F.col("o_totalprice").alias("a"))
    return dedupe_column_names(df)


@query("write_cleaned", uses=CUSTOMERS, sql="select * from dirty_customers")
def _(spark, sf):
    source = new_folder(spark, "out") + ".parquet"
    return read_parquet(spark, write_cleaned(view(spark, sf, "dirty_customers"), source))


@query("write_cleaned_csv", sql="select * from nation")
def _(spark, sf):
    source = new_folder(spark, "out") + ".csv"
    df = read_csv(spark, write_cleaned(table(spark, sf, "nation"), source))
    return df.withColumns({c: F.col(c).cast("int") for c in ("n_nationkey", "n_regionkey")})
