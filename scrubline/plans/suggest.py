"""From a profile to issues and to the cleaning steps that answer them.

Everything here works on the small profile table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.cells import number_text
from pyspark.sql import types as T


def _value(signal: str) -> Column:
    return F.max(F.when(F.col("signal") == signal, F.col("value")))


def _formats(signal: str, fine: str) -> list[Column]:
    """Number of formats seen, and whether one of them is not the fine one."""
    hit = F.col("signal") == signal
    return [F.count_if(hit).alias(signal + "s"),
            F.count_if(hit & (F.col("detail") != fine)).alias(signal + "s_odd"),
            F.array_join(F.sort_array(F.collect_list(F.when(hit, F.col("detail")))), ", ")
            .alias(signal + "s_list")]


VALUES = ["currency_like", "numeric_as_string", "bool_as_string", "whitespace", "non_nfc",
          "casing_raw", "casing_folded", "null_pct", "iqr_outliers", "blank_column",
          "bad_name"]


def by_column(profile: DataFrame) -> DataFrame:
    """One row per column with a field per signal."""
    return (profile.filter("col is not null").groupBy("col").agg(
        F.max(F.when(F.col("signal") == "dtype", F.col("value"))).alias("place"),
        F.max(F.when(F.col("signal") == "clean_name", F.col("text"))).alias("clean_name"),
        *_formats("date_format", P.ISO_DATE), *_formats("phone_format", P.INTL_PHONE),
        *[_value(v).alias(v) for v in VALUES],
    ).fillna(0.0, VALUES))


def by_table(profile: DataFrame) -> DataFrame:
    """One row with the signals of the whole table."""
    names = ["n_rows", "blank_rows", "duplicate_rows"]
    whole = profile.filter("col is null or signal in ('blank_column', 'bad_name')")
    return whole.agg(
        *[_value(n).alias(n) for n in names],
        F.max(F.when(F.col("signal") == "bad_name", True)).alias("rename"),
        F.array_sort(F.collect_list(F.when(
            (F.col("signal") == "blank_column") & (F.col("value") > 0), F.col("col"),
        ))).alias("blank_columns"),
    ).fillna(0.0, names).withColumn("rename", F.coalesce("rename", F.lit(False)))


def _whole(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def _issues(df: DataFrame, col: Column, counts: dict[str, Column]) -> DataFrame:
    rows = F.array(*[
        F.struct(F.lit(issue).alias("issue"), col.alias("col"), n.alias("count"))
        for issue, n in counts.items()
    ])
    return df.select(F.inline(rows)).filter(F.col("count").isNotNull())


def issue_list(profile: DataFrame) -> DataFrame:
    """``(issue, col, count)``; a column shows as currency before boolean
    before number."""
    t, c = by_table(profile), by_column(profile)
    none = F.lit(None).cast("string")
    table_rows = _issues(t, none, {
        label: F.when(F.col(signal) > 0, _whole(F.col(signal)))
        for label, signal in (("duplicate rows", "duplicate_rows"),
                              ("blank rows", "blank_rows"))
    })
    currency, bools = F.col("currency_like") > 0, F.col("bool_as_string") > 0
    numbers = F.col("numeric_as_string") > 0
    spaces = F.col("whitespace") + F.col("non_nfc")
    found = {
        "empty column": F.when(F.col("blank_column") > 0, F.lit("all rows")),
        "mixed date formats": F.when(F.col("date_formats_odd") > 0,
                                     _whole(F.col("date_formats"))),
        "phone format chaos": F.when(F.col("phone_formats_odd") > 0,
                                     _whole(F.col("phone_formats"))),
        "currency strings": F.when(currency, _whole(F.col("currency_like"))),
        "bools as strings": F.when(~currency & bools, _whole(F.col("bool_as_string"))),
        "numbers as strings": F.when(~currency & ~bools & numbers,
                                     _whole(F.col("numeric_as_string"))),
        "category casing variants": F.when(
            F.col("casing_raw") > 0,
            F.concat(_whole(F.col("casing_raw")), F.lit(" -> "),
                     _whole(F.col("casing_folded")))),
        "whitespace / unicode": F.when(spaces > 0, _whole(spaces)),
        "missing values": F.when(
            F.col("null_pct") > 0,
            F.concat(number_text(F.col("null_pct"), T.DoubleType()), F.lit("%"))),
        "statistical outliers": F.when(F.col("iqr_outliers") > 0,
                                       _whole(F.col("iqr_outliers"))),
    }
    return table_rows.unionByName(_issues(c, F.col("col"), found))


#: A column with this share of missing cells or more, in percent, gets no flag.
MOSTLY_MISSING = 50.0


def suggest_steps(profile: DataFrame, columns: list[str] | None = None,
                  mostly_missing: float = MOSTLY_MISSING) -> DataFrame:
    """``(ord, tool, col, params, reason)``: the steps the profile calls for.

    Order matters: names, blank rows, blank columns, duplicates, then column
    by column from white space to flags.  ``columns`` keeps the steps on those
    columns and the ones on the whole table.
    """
    t = by_table(profile)
    c = by_column(profile).withColumn("rename", t.select("rename").scalar())
    no_col = F.lit(None).cast("string")

    def entry(place, rank, tool, col, params, reason, cond):
        return F.when(cond, F.struct(
            place.cast("double").alias("place"), F.lit(rank).alias("rank"),
            F.lit(tool).alias("tool"), col.alias("col"),
            F.lit(json.dumps(params)).alias("params"), reason.alias("reason")))

    first = F.lit(-1.0)
    blanks = F.col("blank_columns")
    table_steps = [
        entry(first, 0, "rename_columns", no_col, {},
              F.lit("column names are not snake_case"), F.col("rename")),
        entry(first, 1, "drop_blank_rows", no_col, {},
              F.concat(_whole(F.col("blank_rows")), F.lit(" blank rows")),
              F.col("blank_rows") > 0),
        entry(first, 2, "drop_blank_columns", no_col, {},
              F.concat(F.lit("blank columns: "), F.array_join(blanks, ", ")),
              F.size(blanks) > 0),
        entry(first, 3, "drop_duplicates", no_col, {},
              F.concat(_whole(F.col("duplicate_rows")), F.lit(" repeated rows")),
              F.col("duplicate_rows") > 0),
    ]
    target = F.when(F.col("rename"), F.col("clean_name")).otherwise(F.col("col"))
    here = F.col("place")
    currency, bools = F.col("currency_like") > 0, F.col("bool_as_string") > 0
    casing = F.col("casing_raw") > 0
    nulls = F.col("null_pct")
    column_steps = [
        entry(here, 0, "trim_whitespace", target, {},
              F.concat(_whole(F.col("whitespace")), F.lit(" white space, "),
                       _whole(F.col("non_nfc")), F.lit(" unicode issues")),
              F.col("whitespace") + F.col("non_nfc") > 0),
        entry(here, 1, "normalize_dates", target, {},
              F.concat(F.lit("date formats: "), F.col("date_formats_list")),
              F.col("date_formats_odd") > 0),
        entry(here, 2, "normalize_phone", target, {},
              F.concat(F.lit("phone formats: "), F.col("phone_formats_list")),
              F.col("phone_formats_odd") > 0),
        entry(here, 3, "normalize_currency", target, {},
              F.concat(_whole(F.col("currency_like")), F.lit(" currency cells")), currency),
        entry(here, 4, "fix_dtypes", target, {"target": "bool"},
              F.lit("booleans stored as text"), ~currency & bools),
        entry(here, 5, "fix_dtypes", target, {"target": "numeric"},
              F.concat(_whole(F.col("numeric_as_string")), F.lit(" numbers stored as text")),
              ~currency & ~bools & (F.col("numeric_as_string") > 0)
              & (F.col("phone_formats") == 0) & ~casing),
        entry(here, 6, "standardize_categories", target, {},
              F.concat(_whole(F.col("casing_raw")), F.lit(" spellings of "),
                       _whole(F.col("casing_folded")), F.lit(" categories")), casing),
        entry(here, 7, "impute_missing", target, {"strategy": "flag_only"},
              F.concat(number_text(nulls, T.DoubleType()), F.lit("% missing, flagged only")),
              (nulls > 0) & (nulls < mostly_missing)),
        entry(here, 8, "flag_outliers", target, {"method": "iqr"},
              F.concat(_whole(F.col("iqr_outliers")), F.lit(" outliers, flagged only")),
              F.col("iqr_outliers") > 0),
    ]
    steps = (t.select(F.explode(F.array_compact(F.array(*table_steps))).alias("s"))
             .unionByName(c.select(F.explode(F.array_compact(F.array(*column_steps)))
                                   .alias("s"))).select("s.*"))
    if columns is not None:
        steps = steps.filter(F.col("col").isNull() | F.col("col").isin(columns))
    # A profile holds a bounded number of steps, so one sorted window will do.
    order = Window.orderBy("place", "rank")
    return steps.select(F.row_number().over(order).alias("ord"),
                        "tool", "col", "params", "reason")


def collect_steps(steps: DataFrame) -> list[dict]:
    """Suggested steps as the list of dicts a recipe holds."""
    return [{"tool": r["tool"], "col": r["col"], "params": json.loads(r["params"]),
             "reason": r["reason"]} for r in steps.orderBy("ord").collect()]
