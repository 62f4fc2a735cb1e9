"""Cell and row differences between two versions of a table, and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.cells import col as c_
from ..operators import apply_step
from ..session import broadcast_if_small

_B, _A = "_b", "_a"


def _differs(before: DataFrame, after: DataFrame, name: str) -> Column:
    """Typed comparison where both sides have one type, text otherwise."""
    b, a = F.col(f"{_B}.`{name}`"), F.col(f"{_A}.`{name}`")
    if before.schema[name].dataType == after.schema[name].dataType:
        return ~b.eqNullSafe(a)
    return ~_text(before, name, _B).eqNullSafe(_text(after, name, _A))


def _text(df: DataFrame, name: str, side: str) -> Column:
    dtype, c = df.schema[name].dataType, F.col(f"{side}.`{name}`")
    return c if cells.kind_of(dtype) == "text" else cells.number_text(c, dtype)


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    return apply_step(df.filter(c_(key).isNotNull()), "drop_duplicates",
                      params={"subset": [key]})


def diff_cells(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, col, before, after)`` for each changed cell of rows in both.

    A key that repeats stands for its first row on either side, so no key can
    multiply rows; the rows left out are gone before the shuffle of the join.
    Rows are compared first and only the changed cells of changed rows are
    written out, so a run that touched little moves little.
    """
    shared = [c for c in before.columns if c in after.columns and c != key]
    joined = one_per_key(before, key).alias(_B).join(
        one_per_key(after, key).alias(_A), F.col(f"{_B}.`{key}`") ==
        F.col(f"{_A}.`{key}`"))
    parts = [
        F.when(_differs(before, after, c), F.struct(
            F.lit(c).alias("col"), _text(before, c, _B).alias("before"),
            _text(after, c, _A).alias("after")))
        for c in shared
    ]
    if not parts:
        return joined.select(F.col(f"{_B}.`{key}`").alias("key"), F.lit("").alias("col"),
                             F.lit("").alias("before"), F.lit("").alias("after")).limit(0)
    return (joined.select(F.col(f"{_B}.`{key}`").cast("string").alias("key"),
                          F.explode(F.array_compact(F.array(*parts))).alias("d"))
            .select("key", "d.*"))


def removed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of ``before`` that ``after`` no longer has."""
    return (before.select(c_(key).alias("key")).filter("key is not null").distinct()
            .join(after.select(c_(key).alias("key")).filter("key is not null").distinct(),
                  "key", "left_anti"))


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]


def diff_summary(cells_changed: DataFrame) -> DataFrame:
    """``(col, n_changed)``."""
    return cells_changed.groupBy("col").agg(F.count(F.lit(1)).alias("n_changed"))


def patch_cells(df: DataFrame, edits: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Apply ``(key, col, value)`` edits; an empty value clears the cell.

    The edits are pivoted to one row per key, so the join adds no rows.  Of
    several edits of a cell the last by the column ``order`` wins, by value
    without one.  A value that does not fit the column's type leaves the cell as
    it is (:func:`rejected_edits` lists those); an edit of a column that is not
    there raises ``ValueError``.
    """
    names = [c for c in df.columns if c != key]
    stray = edits.filter(~F.col("col").isin(names)).select("col").first()
    if stray:
        raise ValueError(f"edit of an unknown column: {stray['col']}")
    last = F.col(order) if order else F.lit(0)
    wide = edits.groupBy(F.col("key").alias("_k")).agg(*[
        F.max(F.when(F.col("col") == c, F.struct(
            last.alias("o"), F.lit(True).alias("on"), F.coalesce("value", F.lit("")).alias("v")))).alias(f"_p{i}")
        for i, c in enumerate(names)
    ])
    joined = df.join(broadcast_if_small(wide), c_(key).cast("string") == F.col("_k").cast("string"), "left")
    out = []
    for c in df.columns:
        if c == key:
            out.append(c_(c))
            continue
        p = F.col(f"_p{names.index(c)}")
        value = p["v"].try_cast(df.schema[c].dataType)
        out.append(F.when(p["v"] == "", F.lit(None)).when(value.isNotNull(), value)
                   .otherwise(c_(c)).alias(c))
    return joined.select(*out)


def rejected_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits whose value does not fit their column, or names none."""
    fits = F.lit(False)
    for c in df.columns:
        fits = fits | ((F.col("col") == c) & F.col("value").try_cast(df.schema[c].dataType).isNotNull())
    return edits.filter(~(F.coalesce(fits, F.lit(False)) | (
        F.col("col").isin(df.columns) & (F.coalesce("value", F.lit("")) == ""))))


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose key is listed in ``keys.key``."""
    listed = keys.select(F.col("key").alias("_k")).distinct()
    return df.join(broadcast_if_small(listed), c_(key) == F.col("_k"), "left_anti")
