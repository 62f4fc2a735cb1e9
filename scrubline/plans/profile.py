"""The metadata profile of a table.

A profile is a long table ``(col, signal, detail, value, text)``, a few dozen
rows per column however large the input.  It is gathered in a fixed number of
passes, each an aggregate with map-side combine:

* ``table_signals``: rows, nulls, blanks; one row per partition is shuffled;
* ``number_signals``: the columns are unpivoted on the fly and aggregated per
  column, again a handful of rows per partition;
* ``value_frequencies``: the only wide shuffle, distinct values per column,
  long texts as digests; distinct counts, casing variants and top values all
  come from it;
* ``text_signals``: likewise per column, over the distinct short texts of the
  frequencies, each with its number of cells, and over the long texts;
* ``duplicate_rows``: one group-by over whole rows, long texts as digests;
* outliers: exact quantiles by narrowing, then one counting pass.

``profile_by`` profiles many tables that stand in one, told apart by a column:
the passes and jobs are those of one table, whatever the number of tables.
Inside, the key of a column is then the table's name, a separator and the
column's name.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, masks
from ..functions import patterns as P
from ..functions.cells import col as c_
from ..functions.text import distinct_names, non_ascii, snake_case
from ..operators.missing import fences
from ..operators.quantiles import per_group, quantiles
from ..operators.rows import filled_cells
from ..session import Workspace, small_table, stage

SCHEMA = "col string, signal string, detail string, value double, text string"
TOP = 5
SEPARATOR = "\x1f"
#: A column of this many distinct values, or of this share of the rows if that is
#: more, is looked at for spellings that differ only in case and margins.
CASING_VALUES, CASING_SHARE = 20, 0.05
#: A text column of more than this many values, more than this share of them
#: numbers, is looked at for outliers.
NUMBER_VALUES, NUMBER_SHARE = 10, 0.9
#: A key column has this share of distinct values at least.
KEY_SHARE = 0.9


def _by_kind(df: DataFrame, *wanted: str) -> list[str]:
    return [n for n, k in cells.kinds(df).items() if k in wanted]


def _key(by: str | None, name: str) -> Column:
    """What stands for a column: its name, after its table's if there are several."""
    return F.lit(name) if by is None else F.concat(c_(by), F.lit(SEPARATOR + name))


def split_key(key: str) -> tuple[str | None, str]:
    group, mark, name = key.rpartition(SEPARATOR)
    return (group if mark else None), name


def _of(df: DataFrame, by: str | None) -> DataFrame:
    return df if by is None else df.drop(c_(by))


def _long(df: DataFrame, columns: dict[str, Column], by: str | None = None) -> DataFrame:
    """``(col, x)`` with one row per cell of the given expressions."""
    cells_ = [part for n, e in columns.items() for part in (_key(by, n), e)]
    return df.select(F.stack(F.lit(len(columns)), *cells_).alias("col", "x"))


def _quoted(text: str | None) -> str:
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _signals(df: DataFrame, entries: list[tuple[str, str, str | None, str]]) -> DataFrame:
    """Profile rows from a wide row: each entry is (column as SQL, signal,
    detail, name of the field with the value)."""
    rows = ", ".join(
        f"struct({col} as col, {_quoted(signal)} as signal, {_quoted(detail)} as detail, "
        f"cast({value} as double) as value, cast(null as string) as text)"
        for col, signal, detail, value in entries
    )
    return df.selectExpr(f"inline(array({rows}))")


def null_share(n_rows: Column, n_filled: Column) -> Column:
    share = F.try_divide(n_filled.cast("double"), n_rows.cast("double"))
    return F.coalesce(F.round(100.0 * (1 - share), 2), F.lit(0.0))


def table_signals(df: DataFrame, by: str | None = None) -> DataFrame:
    """n_rows, n_cols, blank rows and columns, and per column the null share."""
    kinds = cells.kinds(_of(df, by))
    names = list(kinds)
    grouped = df.groupBy() if by is None else df.groupBy(c_(by).alias("group"))
    totals = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(filled_cells(_of(df, by)) == 0).alias("blank_rows"),
        *[F.count(c_(n)).alias(f"f{i}") for i, n in enumerate(names)],
        *[F.count_if(~cells.blank(c_(n), kinds[n])).alias(f"b{i}")
          for i, n in enumerate(names)],
    )
    def key(name: str) -> str:
        return _quoted(name) if by is None else f"concat(`group`, {_quoted(SEPARATOR + name)})"

    none = _quoted(None) if by is None else key("")
    rows = [(none, "n_rows", None, "n"), (none, "n_cols", None, str(len(names))),
            (none, "blank_rows", None, "blank_rows")]
    for i, n in enumerate(names):
        rows.append((key(n), "n_filled", None, f"f{i}"))
        rows.append((key(n), "null_pct", None, f"p{i}"))
        rows.append((key(n), "blank_column", None, f"n > 0 and b{i} = 0"))
    shares = {f"p{i}": null_share(F.col("n"), F.col(f"f{i}")) for i in range(len(names))}
    return _signals(totals.withColumns(shares), rows)


def text_values(df: DataFrame, by: str | None = None) -> DataFrame:
    """``(col, x)``: every non-null cell of the text columns."""
    names = _by_kind(_of(df, by), "text")
    if not names:
        return small_table(df.sparkSession, [], "col string, x string")
    return _long(df, {n: c_(n) for n in names}, by).filter("x is not null")


def _which(c: Column, patterns: dict[str, str], possible: dict[str, Column]) -> Column:
    """Index of the format a cell has; no cell has two of them, so the tests
    stop at the first that fits."""
    out = None
    for i, (name, p) in enumerate(patterns.items()):
        hit = possible.get(name, possible["other"]) & c.rlike(p)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def counted_texts(df: DataFrame, freq: DataFrame, by: str | None = None) -> DataFrame:
    """``(col, x, n)``: the distinct texts of every column and how many cells hold
    them.  Short ones stand in the frequencies; long ones, known there by their
    digest only, are taken from the table cell by cell."""
    names = _by_kind(_of(df, by), "text")
    name = F.substring_index("col", SEPARATOR, -1) if by else F.col("col")
    short = freq.filter(name.isin(names) & F.col("k").startswith("=")).select(
        "col", F.expr("substring(k, 2)").alias("x"), "n")
    long = text_values(df, by).filter(F.length("x") > cells.LONGEST_KEY)
    return short.unionByName(long.withColumn("n", F.lit(1).cast("bigint")))


def text_counts(values: DataFrame) -> DataFrame:
    """Format and cleanliness counts per column of ``(col, x, n)``, where ``n``
    cells hold ``x``.

    The first character and the length decide which patterns a cell can match
    at all, so plain text is hardly ever given to a pattern, and long text to
    only two of them.  A pattern's ``$`` also stands before a last line feed,
    hence one character more than the formats are long.
    """
    x, bare, head, n = F.col("x"), F.col("bare"), F.col("head"), F.col("chars")
    digit = head.between("0", "9")
    dated = {"long (Month DD, YYYY)": head.between("A", "Z"),
             "other": digit & n.between(8, 11)}
    phoned = {"other": head.isin("0", "+", "6") & n.between(11, 16)}
    seen = (
        values.withColumn("bare", cells.strip(x))
        .withColumn("head", F.substring(x, 1, 1)).withColumn("chars", F.length(x))
        .withColumn("date", _which(x, P.DATE_FORMATS, dated))
        .withColumn("phone", F.when(F.col("date").isNull(),
                                    _which(x, P.PHONE_FORMATS, phoned)))
        .withColumn("head", F.substring(bare, 1, 1))
        .withColumn("numeric", (digit | head.isin("-", ",")) & bare.rlike(P.U + P.NUMERIC_CELL))
    )
    currency = head.isin("₱", "P", "p", "$", "U") & bare.rlike(P.U + P.CURRENCY_CELL)
    bools = (F.length(bare) <= 5) & F.lower(bare).isin(P.BOOL_WORDS)
    # Digits and commas are a number once the commas are gone; other spellings
    # (signs, exponents) are parsed.
    number = F.when(F.col("numeric") & digit, True).otherwise(
        head.isin(*"0123456789+-.,iI") & cells.grouped_text_to_number(bare).isNotNull())

    def cells_of(hit: Column) -> Column:
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    return seen.groupBy("col").agg(
        F.sum("n").alias("n"),
        *[cells_of(F.col("date") == i).alias(f"p{i}") for i in range(len(P.DATE_FORMATS))],
        *[cells_of(F.col("phone") == i).alias(f"p{len(P.DATE_FORMATS) + i}")
          for i in range(len(P.PHONE_FORMATS))],
        cells_of(currency).alias("currency"), cells_of(F.col("numeric")).alias("numeric"),
        cells_of(bools).alias("bools"),
        (cells_of(x != bare) + cells_of(cells.has_double_space(x))).alias("spaces"),
        cells_of(number).alias("numbers"), cells_of(non_ascii(x)).alias("non_ascii"),
    )


def text_signals(df: DataFrame, by: str | None = None, number_values: int = NUMBER_VALUES,
                 number_share: float = NUMBER_SHARE, values: DataFrame | None = None) -> DataFrame:
    """Date, phone, currency, number, boolean and white-space signals.

    ``values`` may hold the distinct texts already, see ``counted_texts``.
    """
    if values is None:
        values = text_values(df, by).withColumn("n", F.lit(1).cast("bigint"))
    n_dates, n_phones = len(P.DATE_FORMATS), len(P.PHONE_FORMATS)
    dates = [f"p{i}" for i in range(n_dates)]
    phones = [f"p{n_dates + i}" for i in range(n_phones)]
    no_date = f"greatest({', '.join(dates)}) = 0"
    no_phone = f"greatest({', '.join(phones)}) = 0"
    entries = [("col", "date_format", d, p) for d, p in zip(P.DATE_FORMATS, dates)]
    entries += [("col", "phone_format", d, p) for d, p in zip(P.PHONE_FORMATS, phones)]
    entries += [
        ("col", "currency_like", None, "currency"),
        ("col", "numeric_as_string", None, f"if({no_date}, numeric, null)"),
        ("col", "bool_as_string", None, "if(bools = n, n, null)"),
        ("col", "whitespace", None, "spaces"),
        ("col", "number_like", None,
         f"if({no_date} and {no_phone} and numbers > {float(number_share)}D * n "
         f"and n > {int(number_values)}, numbers, null)"),
        ("col", "non_ascii", None, "non_ascii"),
    ]
    return _signals(text_counts(values), entries).filter("value > 0")


def nfc_signals(df: DataFrame, by: str | None = None, values: DataFrame | None = None) -> DataFrame:
    """Cells not in composed Unicode form; only non-ASCII text is looked at."""
    if values is None:
        values = text_values(df, by).withColumn("n", F.lit(1).cast("bigint"))

    @F.pandas_udf(T.BooleanType())
    def decomposed(x: pd.Series) -> pd.Series:
        import unicodedata
        return ~x.map(lambda v: unicodedata.is_normalized("NFC", v)).astype(bool)

    counted = (values.filter(non_ascii(F.col("x"))).withColumn("decomposed", decomposed("x"))
               .groupBy("col").agg(F.sum(F.when(F.col("decomposed"), F.col("n")).otherwise(0)).alias("n")))
    return _signals(counted, [("col", "non_nfc", None, "n")]).filter("value > 0")


def number_values(df: DataFrame, by: str | None = None) -> DataFrame:
    names = _by_kind(_of(df, by), "number")
    if not names:
        return small_table(df.sparkSession, [], "col string, x double")
    return _long(df, {n: c_(n).cast("double") for n in names}, by).filter("x is not null")


def number_signals(df: DataFrame, by: str | None = None) -> DataFrame:
    """min, max, mean and sample deviation per number column."""
    stats = number_values(df, by).groupBy("col").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return _signals(stats, [
        ("col", "min", None, "lo"), ("col", "max", None, "hi"),
        ("col", "mean", None, "round(mean, 4)"), ("col", "std", None, "round(std, 4)"),
    ]).filter("value is not null")


def value_frequencies(df: DataFrame, by: str | None = None) -> DataFrame:
    """``(col, k, f, n)``: distinct cells per column as grouping keys, with
    the key of their folded form, and how many rows hold them.

    The folded form of a short text follows from its key and is made once for each
    distinct text; only long texts, known by digests, carry it through the shuffle.
    """
    parts = []
    if texts := _by_kind(_of(df, by), "text"):
        x, is_long = F.col("x"), F.length("x") > cells.LONGEST_KEY
        parts.append(_long(df, {n: c_(n) for n in texts}, by).filter("x is not null")
                     .select("col", cells.group_key(x).alias("k"),
                             F.when(is_long, cells.group_key(cells.fold(x))).alias("f")))
    if others := [f.name for f in df.schema.fields
                  if cells.kind_of(f.dataType) in ("number", "bool")
                  or isinstance(f.dataType, (T.DateType, T.TimestampType,
                                             T.TimestampNTZType))]:
        x = F.concat(F.lit("="), F.col("x"))
        floats = (T.FloatType, T.DoubleType)  # adding zero makes -0.0 and 0.0 one value
        parts.append(_long(df, {n: (c_(n) + F.lit(0.0).cast(df.schema[n].dataType) if isinstance(
            df.schema[n].dataType, floats) else c_(n)).cast("string") for n in others}, by)
                     .filter("x is not null")
                     .select("col", x.alias("k"), F.lit(None).cast("string").alias("f")))
    if not parts:
        return small_table(df.sparkSession, [], "col string, k string, f string, n bigint")
    counted = [p.groupBy("col", "k", "f").agg(F.count(F.lit(1)).alias("n")) for p in parts]
    if texts:
        folded = cells.group_key(cells.fold(F.expr("substring(k, 2)")))
        counted[0] = counted[0].withColumn("f", F.coalesce("f", folded))
    if others:
        counted[-1] = counted[-1].withColumn("f", F.col("k"))
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def distinct_counts(freq: DataFrame) -> DataFrame:
    """``(col, n_unique, folded)`` by two plain counts, no row expansion."""
    return (freq.groupBy("col", "f").agg(F.count(F.lit(1)).alias("forms"))
            .groupBy("col").agg(F.sum("forms").alias("n_unique"),
                                F.count(F.lit(1)).alias("folded")))


def top_keys(freq: DataFrame, top: int = TOP) -> DataFrame:
    """The most frequent values per column; the rank limit is applied in every
    map task before the shuffle, so a column's values never meet in one task."""
    order = Window.partitionBy("col").orderBy(F.desc("n"), F.asc("k"))
    return freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def top_values(df: DataFrame, freq: DataFrame, names: list[str], by: str | None = None) -> DataFrame:
    """``(col, rank, n, value)`` with masked texts.

    A long text is known by its digest only; the few that made the top are
    looked up in the table again.
    """
    names = [n for n in names if n in _by_kind(_of(df, by), "text")]
    name = F.substring_index("col", SEPARATOR, -1) if by else F.col("col")
    keys = top_keys(freq.filter(name.isin(names)))
    found = keys.withColumn("x", F.when(F.col("k").startswith("="), F.expr("substring(k, 2)")))
    digests = [r for r in found.select("col", "k", "rank", "n", "x").collect()]
    missing = [(r["col"], r["k"]) for r in digests if r["x"] is None]
    texts: dict[tuple[str, str], str] = {}
    if missing:
        wanted = small_table(df.sparkSession, missing, "col string, k string")
        some = sorted({split_key(m[0])[1] if by else m[0] for m in missing})
        hits = (text_values(df.select(*([c_(by)] if by else []), *[c_(n) for n in some]), by)
                .withColumn("k", cells.group_key(F.col("x")))
                .join(F.broadcast(wanted), ["col", "k"], "left_semi")
                .groupBy("col", "k").agg(F.min("x").alias("x")))
        texts = {(r["col"], r["k"]): r["x"] for r in hits.collect()}
    rows = [(r["col"], r["rank"], r["n"], r["x"] if r["x"] is not None
             else texts[r["col"], r["k"]]) for r in digests]
    table = small_table(df.sparkSession, rows, "col string, rank int, n bigint, x string")
    hidden = [n for n in names if masks.is_sensitive(n)]
    return table.select("col", "rank", "n", F.when(
        name.isin(hidden), masks.mask_whole(F.col("x"))
    ).otherwise(masks.mask_all(F.col("x"))).alias("value"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n``: rows beyond the first of each group of equal rows."""
    keys = [cells.group_key(c_(f.name)) if cells.kind_of(f.dataType) == "text"
            else c_(f.name) for f in df.schema.fields]
    groups = (df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
              .groupBy(*[f"k{i}" for i in range(len(keys))])
              .agg(F.count(F.lit(1)).alias("m")))
    return groups.agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n"))


def repeated_by(df: DataFrame, by: str) -> dict[str, int]:
    """``duplicate_rows`` of every table."""
    keys = [cells.group_key(c_(f.name)) if cells.kind_of(f.dataType) == "text"
            else c_(f.name) for f in _of(df, by).schema.fields]
    groups = (df.select(c_(by).alias("group"), *[k.alias(f"k{i}") for i, k in enumerate(keys)])
              .groupBy("group", *[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("m")))
    return {r["group"]: r["n"] for r in groups.groupBy("group").agg(F.sum(F.col("m") - 1).alias("n")).collect()}


def outliers_by(df: DataFrame, columns: dict[str, Column], by: str,
                approximate: bool = False) -> dict[tuple[str, str], int]:
    """``outlier_counts`` of every table: ``{(group, column): n}``."""
    if not columns:
        return {}
    quartiles = quantiles(df, columns, [0.25, 0.75], approximate, by)
    low, high = {n: {} for n in columns}, {n: {} for n in columns}
    for g, found in quartiles.items():
        for n, (q1, q3) in found.items():
            if q1 is not None and q3 > q1:
                low[n][g], high[n][g] = fences(q1, q3)
    counted = df.groupBy(c_(by).alias("group")).agg(*[
        F.count_if((columns[n] < per_group(by, low[n])) | (columns[n] > per_group(by, high[n]))).alias(f"n{i}")
        for i, n in enumerate(columns)]).collect()
    return {(r["group"], n): r[f"n{i}"] for r in counted for i, n in enumerate(columns) if r[f"n{i}"]}


def outlier_counts(df: DataFrame, columns: dict[str, Column],
                   approximate: bool = False) -> DataFrame:
    """``(col, n)``: cells outside the quartile fences, where the quartiles
    differ.  All columns share the quantile passes and the counting pass."""
    spark = df.sparkSession
    quartiles = quantiles(df, columns, [0.25, 0.75], approximate)
    limits = {n: fences(q1, q3) for n, (q1, q3) in quartiles.items()
              if q1 is not None and q3 > q1}
    if not limits:
        return small_table(spark, [], "col string, n bigint")
    counts = df.agg(*[
        F.count_if((columns[n] < low) | (columns[n] > high)).alias(f"n{i}")
        for i, (n, (low, high)) in enumerate(limits.items())
    ])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("col"), F.col(f"n{i}").alias("n"))
        for i, n in enumerate(limits)
    ]))).filter("n > 0")


def duplicate_keys(df: DataFrame, distinct: DataFrame, shape: DataFrame,
                   share: float = KEY_SHARE) -> DataFrame:
    """``(col, n)``: repeated values in columns that look like keys."""
    names = [n for n in df.columns if re.search(P.KEY_COLUMN, n)]
    n_rows = shape.filter("signal = 'n_rows'").select("value").scalar()
    filled = shape.filter("signal = 'n_filled'").select("col", F.col("value").alias("filled"))
    candidates = (distinct.filter(F.col("col").isin(names))
                  .join(filled, "col").withColumn("rows", n_rows)
                  .filter(F.col("n_unique") >= share * F.col("rows")))
    has_null = (F.col("filled") < F.col("rows")).cast("int")
    return candidates.select(
        "col", (F.col("rows") - F.col("n_unique") - has_null).cast("bigint").alias("n")
    ).filter("n > 0")


def column_rows(df: DataFrame) -> list[tuple]:
    """Schema rows of the profile: type, position, clean name, bad name."""
    clean = distinct_names([snake_case(n) or n for n in df.columns])
    rows = []
    for i, (f, name) in enumerate(zip(df.schema.fields, clean)):
        rows.append((f.name, "dtype", cells.kind_of(f.dataType), float(i),
                     f.dataType.simpleString()))
        rows.append((f.name, "clean_name", None, None, name))
        if not re.fullmatch(r"[a-z0-9_]+", f.name):
            rows.append((f.name, "bad_name", None, 1.0, None))
    return rows


@dataclass(frozen=True)
class Limits:
    """Where a signal starts to count; ``None`` looks at every column."""
    casing_values: int | None = CASING_VALUES
    casing_share: float = CASING_SHARE
    number_values: int = NUMBER_VALUES
    number_share: float = NUMBER_SHARE
    key_share: float = KEY_SHARE


def profile(df: DataFrame, approximate: bool = False, limits: Limits = Limits()) -> DataFrame:
    """The whole profile.  The passes run here, side by side where they do not
    need each other; the result is a small local table, so whatever is derived
    from it costs no further scan."""
    rows = _profiles(cells.nan_to_null(df), None, [None], approximate, limits)
    return small_table(df.sparkSession, rows[None], SCHEMA)


def profile_by(df: DataFrame, by: str, groups: list[str], approximate: bool = False,
               limits: Limits = Limits()) -> DataFrame:
    """``(group, col, ...)``: the profiles of all tables that ``by`` tells apart,
    in as many jobs as one takes.  ``groups`` names them, those without rows too."""
    rows = _profiles(cells.nan_to_null(df), by, groups, approximate, limits)
    return small_table(df.sparkSession, [(g, *r) for g in groups for r in rows[g]],
                       "group string, " + SCHEMA)


def _profiles(df: DataFrame, by: str | None, groups: list, approximate: bool,
              limits: Limits) -> dict[str | None, list[tuple]]:
    """Profile rows of every group; without ``by`` the only group is None."""
    with Workspace(df.sparkSession), ThreadPoolExecutor(4) as pool:
        def later(job, *args):
            return pool.submit(inheritable_thread_target(df.sparkSession)(job), *args)

        shape = later(lambda: _told(table_signals(df, by).collect(), by))
        numbers = later(lambda: _told(number_signals(df, by).collect(), by))
        repeated = later(lambda: {None: duplicate_rows(df).first()["n"]} if by is None else repeated_by(df, by))
        freq = stage(value_frequencies(df, by), "frequencies")
        texts = later(_text_rows, df, by, limits, freq)
        outliers = later(_outlier_rows, df, by, texts, approximate)
        values = _value_rows(df, by, freq, shape.result(), groups, limits)
    out = {}
    schema_rows = column_rows(_of(df, by))
    for g in groups:
        rows = list(schema_rows)
        rows += [r for r in shape.result().get(g) or _no_rows(_of(df, by))
                 if r[3] or r[1] in ("n_rows", "n_cols", "null_pct", "n_filled")]
        rows += [r for r in texts.result().get(g, []) if r[1] != "non_ascii"]
        rows += numbers.result().get(g, []) + outliers.result().get(g, []) + values[g]
        if n := repeated.result().get(g):
            rows.append((None, "duplicate_rows", None, float(n), None))
        out[g] = rows
    return out


def _told(rows: list, by: str | None) -> dict[str | None, list[tuple]]:
    """Collected profile rows by group, with plain column names."""
    if by is None:
        return {None: [tuple(r) for r in rows]}
    out: dict[str | None, list[tuple]] = {}
    for r in rows:
        group, name = split_key(r["col"])
        out.setdefault(group, []).append((name or None, *tuple(r)[1:]))
    return out


def _no_rows(df: DataFrame) -> list[tuple]:
    """The table signals of a table that has columns only."""
    rows = [(None, "n_rows", None, 0.0, None), (None, "n_cols", None, float(len(df.columns)), None)]
    return rows + [(n, s, None, 0.0, None) for n in df.columns for s in ("n_filled", "null_pct")]


def _text_rows(df: DataFrame, by: str | None, limits: Limits, freq: DataFrame) -> dict:
    values = counted_texts(df, freq, by)
    found = text_signals(df, by, limits.number_values, limits.number_share, values).collect()
    if any(r["signal"] == "non_ascii" for r in found):
        found += nfc_signals(df, by, values).collect()
    return _told(found, by)


def _outlier_rows(df: DataFrame, by: str | None, texts, approximate: bool) -> dict:
    like = [(g, r[0]) for g, rows in texts.result().items() for r in rows if r[1] == "number_like"]
    numeric = {n: c_(n).cast("double") for n in _by_kind(_of(df, by), "number")}
    numeric |= {n: cells.grouped_text_to_number(c_(n)) for n in sorted({n for _, n in like})}
    wanted = set(like) | {(g, n) for n in _by_kind(_of(df, by), "number") for g in (None,)}
    with Workspace(df.sparkSession):
        if like:  # texts are parsed once, the passes read numbers
            df = stage(df.select(*([c_(by)] if by else []), *[
                e.alias(f"number_{i}") for i, e in enumerate(numeric.values())]), "numbers")
            numeric = {n: F.col(f"number_{i}") for i, n in enumerate(numeric)}
        if by is None:
            return {None: [(r["col"], "iqr_outliers", None, float(r["n"]), None)
                           for r in outlier_counts(df, numeric, approximate).collect()]}
        out: dict = {}
        for (g, n), k in outliers_by(df, numeric, by, approximate).items():
            if (g, n) in wanted or (None, n) in wanted:
                out.setdefault(g, []).append((n, "iqr_outliers", None, float(k), None))
        return out


def _value_rows(df: DataFrame, by: str | None, freq: DataFrame, shape: dict, groups: list,
                limits: Limits) -> dict:
    """Signals that come from the value frequencies."""
    kinds = cells.kinds(_of(df, by))
    out: dict = {g: [] for g in groups}
    distinct = {(split_key(r["col"]) if by else (None, r["col"])): r for r in distinct_counts(freq).collect()}
    for g in groups:
        rows, signals = out[g], shape.get(g) or _no_rows(_of(df, by))
        n_rows = next(r[3] for r in signals if r[1] == "n_rows")
        filled = {r[0]: r[3] for r in signals if r[1] == "n_filled"}
        few = float("inf") if limits.casing_values is None else max(
            limits.casing_values, n_rows * limits.casing_share + 1e-6)
        for name in kinds:
            r = distinct.get((g, name))
            n_unique = float(r["n_unique"]) if r else 0.0
            rows.append((name, "n_unique", None, n_unique, None))
            if r and kinds[name] == "text" and n_unique <= few and r["folded"] < n_unique:
                rows.append((name, "casing_raw", None, n_unique, None))
                rows.append((name, "casing_folded", None, float(r["folded"]), None))
            if re.search(P.KEY_COLUMN, name) and n_unique >= limits.key_share * n_rows:
                repeated = n_rows - n_unique - (filled[name] < n_rows)
                if repeated > 0:
                    rows.append((name, "duplicate_keys", None, float(repeated), None))
    for r in top_values(df, freq, list(kinds), by).collect():
        group, name = split_key(r["col"]) if by else (None, r["col"])
        out[group].append((name, "top_value", str(r["rank"]), float(r["n"]), r["value"]))
    return out


def as_dict(profile_table: DataFrame) -> dict:
    """A profile as nested dict, for people and for JSON."""
    out: dict = {"columns": {}}
    for r in profile_table.collect():
        place = out if r["col"] is None else out["columns"].setdefault(r["col"], {})
        if r["signal"] in ("date_format", "phone_format"):
            place.setdefault(r["signal"] + "s", {})[r["detail"]] = int(r["value"])
        elif r["signal"] == "top_value":
            place.setdefault("top_values", []).append(r["text"])
        elif r["signal"] in ("dtype", "clean_name"):
            place[r["signal"]] = r["text"]
        else:
            place[r["signal"]] = r["value"]
    return out
