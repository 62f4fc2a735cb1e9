"""Steps that remove rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.cells import col as c_
from ..functions.regex import java_pattern
from .base import Change, step

_UNORDERED = (T.MapType, T.VariantType)


@step("drop_duplicates", needs_column=False, shuffles=lambda params: True)
def drop_duplicates(df: DataFrame, col, params, fitted) -> Change:
    """Keep one row of each group of equal rows; nulls are equal.

    With ``subset`` (or a column) the row first in ``order_by`` stays; equal
    ``order_by`` values are decided by the other columns, so the result does
    not depend on the partitioning.
    """
    subset = params.get("subset") or ([col] if col else None)
    if not subset:
        return Change(table=df.dropDuplicates())
    order_by = params.get("order_by") or []
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = [f.name for f in df.schema.fields
            if f.name not in subset + order_by and not isinstance(f.dataType, _UNORDERED)]
    order = [c_(c) for c in order_by + rest] or [F.lit(1)]
    first = Window.partitionBy(*[c_(c) for c in subset]).orderBy(*order)
    kept = df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return Change(table=kept)


def filled_cells(df: DataFrame) -> Column:
    """Number of cells in the row that are not blank."""
    total = F.lit(0)
    for name, kind in cells.kinds(df).items():
        total = total + F.when(cells.blank(c_(name), kind), 0).otherwise(1)
    return total


@step("drop_blank_rows", needs_column=False)
def drop_blank_rows(df: DataFrame, col, params, fitted) -> Change:
    if col:
        return Change(keep=~cells.blank(c_(col), cells.kind(df, col)))
    return Change(keep=filled_cells(df) >= int(params.get("min_non_null", 1)))


def matches(df: DataFrame, col: str, params: dict) -> Column:
    """The condition of a ``drop_rows_where`` step; null cells match only
    ``is_null``."""
    c = c_(col)
    case = bool(params.get("match_case", True))
    if "equals" in params:
        target = params["equals"]
        if cells.kind(df, col) == "number" and _number(target) is not None:
            return c == F.lit(_number(target))
        text, want = cells.as_text(df, col), str(target)
        return text == want if case else F.lower(text) == want.lower()
    if "contains" in params:
        text, want = cells.as_text(df, col), str(params["contains"])
        return text.contains(want) if case else F.lower(text).contains(want.lower())
    if "regex" in params:
        return cells.as_text(df, col).rlike(java_pattern(params["regex"]))
    if params.get("is_null"):
        return c.isNull()
    number, out = cells.as_number(df, col), F.lit(False)
    if "min" in params:
        out = out | (number < float(params["min"]))
    if "max" in params:
        out = out | (number > float(params["max"]))
    return out


def _number(value) -> float | None:
    if isinstance(value, bool):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _one_condition(params: dict) -> None:
    known = ("equals", "contains", "regex", "is_null", "min", "max")
    given = [k for k in known if params.get(k) is not None]
    if not given or (given == ["is_null"] and params["is_null"] is False):
        raise ValueError(f"no condition given; use one of {list(known)}")
    if "regex" in params:
        java_pattern(params["regex"])


@step("drop_rows_where", check=_one_condition, asked_only=lambda params: True)
def drop_rows_where(df: DataFrame, col, params, fitted) -> Change:
    hit = F.coalesce(matches(df, col, params), F.lit(False))
    return Change(keep=hit if params.get("keep") else ~hit)


def row_loss(n_before: int, n_after: int) -> str | None:
    """Refuse a run that leaves no row; a warning text at half or more lost."""
    if n_before and not n_after:
        raise ValueError(f"refused: all {n_before} rows would be removed")
    lost = n_before - n_after
    if n_before and lost / n_before >= 0.5:
        return f"{lost} of {n_before} rows removed ({lost / n_before:.0%})"
    return None


def row_loss_table(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(n_before, n_after, loss, verdict)`` as one lazy row."""
    rows = before.agg(F.count(F.lit(1)).alias("n_before")).withColumn(
        "n_after", after.agg(F.count(F.lit(1))).scalar())
    loss = F.coalesce(F.try_divide(F.col("n_before") - F.col("n_after"), F.col("n_before")),
                      F.lit(0.0))
    verdict = (F.when((F.col("n_before") > 0) & (F.col("n_after") == 0), "refused")
               .when(F.col("loss") >= 0.5, "warning").otherwise("ok"))
    return rows.withColumn("loss", F.round(loss, 6)).withColumn("verdict", verdict)
