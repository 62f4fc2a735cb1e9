"""Steps that merge category spellings or replace categories by codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..session import small_table, stage
from .base import Change, own_column, step
from .lookup import Lookup, attach, build, ranked

_OUT = "_mapped"


def canonical_spellings(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``(k, v, n)``: folded value, its most frequent spelling, rows; with ``by``
    the value comes after its table's name and a separator.

    Counted by spelling first, so that the second aggregate sees one row per
    distinct text and a frequent category is no burden for its reducer.
    Folds whose rows already carry the chosen spelling are left out.
    """
    text = cells.as_text(df, name)
    group = F.concat(c_(by), F.lit("\x1f")) if by else F.lit("")
    spelled = (df.select(group.alias("g"), text.alias("s")).filter("s is not null")
               .groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("k", F.concat("g", cells.fold(F.col("s")))))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("s")))
    return (spelled.groupBy("k")
            .agg(best.alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
            .select("k", cells.strip(F.col("b.s")).alias("v"), "n", "forms",
                    F.col("b.s").alias("first"))
            .filter((F.col("forms") > 1) | (F.col("first") != F.col("v")))
            .select("k", "v", "n"))


def _fit_standardize(df: DataFrame, col, params) -> dict:
    if params.get("mapping"):
        return {"lookup": _given(df, params["mapping"])}
    return {"lookup": build(canonical_spellings(df, col))}


def _given(df: DataFrame, mapping: dict) -> Lookup:
    rows = [Row(k=str(k), v=str(v), n=0) for k, v in mapping.items()]
    table = small_table(df.sparkSession, [tuple(r) for r in rows],
                                            "k string, v string, n bigint")
    return Lookup(table, rows)


@step("standardize_categories", fit=_fit_standardize, writes=own_column)
def standardize_categories(df: DataFrame, col, params, fitted) -> Change:
    """One spelling per category: a given mapping, or the most frequent form
    of each group that differs only in case and margins."""
    old = cells.as_text(df, col)
    key = old if params.get("mapping") else cells.fold(old)
    lookup = fitted["lookup"]
    base = attach(df, key, lookup, _OUT)
    new = F.coalesce(c_(_OUT), old)
    # A given mapping counts every cell it names, an automatic one only those
    # that are not in the chosen spelling yet.
    hit = c_(_OUT).isNotNull() if params.get("mapping") else cells.changed(old, new)
    stats = {"mapping_size": lookup.size}
    return Change(assign={col: new}, base=base, helpers=[_OUT],
                  flags={"rows_affected": hit}, stats=stats)


def _category_order(params: dict) -> None:
    if params.get("order", "sorted") not in ("sorted", "frequency", "appearance"):
        raise ValueError("order must be sorted, frequency or appearance")


def category_codes(df: DataFrame, name: str, order: str = "sorted", start: int = 1,
                   order_by: str | None = None) -> Lookup:
    """``(k, v, n)``: category text, its code, rows.

    Written as a table at every size.  Categories whose ``order_by`` is always
    null come last.
    """
    first = F.min(c_(order_by)) if order_by else F.lit(None)
    found = (df.filter(c_(name).isNotNull())
             .groupBy(cells.as_text(df, name).alias("k"))
             .agg(F.count(F.lit(1)).alias("n"), first.alias("first")))
    if order == "sorted" or (order == "appearance" and not order_by):
        found, keys = found.drop("first"), ["k"]
    elif order == "frequency":
        found, keys = found.drop("first"), ["-n", "k"]
    else:
        keys = ["first", "k"]
    sort = [F.desc("n") if k == "-n" else F.asc_nulls_last(k) for k in keys]
    return build(stage(ranked(found, sort, start).select("k", "v", "n"), "codes"), written=True)


def _fit_encode(df: DataFrame, col, params) -> dict:
    order = params.get("order", "sorted")
    if order == "appearance" and not params.get("order_by"):
        raise ValueError("encode order 'appearance' needs params.order_by: "
                         "a Spark table has no row order of its own")
    return {"lookup": category_codes(df, col, order, int(params.get("start", 1)),
                                     params.get("order_by"))}


@step("encode_categories", fit=_fit_encode, check=_category_order,
      writes=lambda col, params: {f"{col}_code" if params.get("new_column") else col})
def encode_categories(df: DataFrame, col, params, fitted) -> Change:
    """Category text to whole numbers, in place or in ``<col>_code``."""
    target = f"{col}_code" if params.get("new_column") else col
    lookup = fitted["lookup"]
    base = attach(df, cells.as_text(df, col), lookup, _OUT)
    stats = {"target": target, "n_categories": lookup.size,
             "mapping_table": mapping_path(lookup)}
    return Change(assign={target: c_(_OUT)}, base=base, helpers=[_OUT],
                  flags={"rows_affected": c_(col).isNotNull()}, stats=stats)


def mapping_path(lookup: Lookup) -> str:
    """The folder of the written mapping ``k, v, n``."""
    return lookup.table.inputFiles()[0].rsplit("/", 1)[0]


def decode_categories(df: DataFrame, col: str, lookup: Lookup, target: str) -> DataFrame:
    """Codes back to the category text of the mapping that made them."""
    back = lookup.table.select(F.col("v").cast("string").alias("k"),
                               F.col("k").alias("v"), "n") if not lookup.small else None
    rows = [Row(k=str(r["v"]), v=r["k"], n=r["n"]) for r in lookup.rows or []]
    inverse = Lookup(back, None) if rows == [] and back is not None else _rows(df, rows)
    code: Column = c_(col).cast("string")
    return attach(df, code, inverse, target)


def _rows(df: DataFrame, rows: list[Row]) -> Lookup:
    table = small_table(df.sparkSession, [tuple(r) for r in rows],
                                            "k string, v string, n bigint")
    return Lookup(table, rows)
