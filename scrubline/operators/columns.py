"""Steps on whole columns and on the text or numbers in one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, text
from ..functions.cells import col as c_
from ..functions.regex import (check_replacement, java_literal, java_pattern, java_replacement,
                               plain_replacement)
from .base import Change, own_column, step
from .needs import Need


def _named(df: DataFrame, col, params) -> list[str]:
    names = list(params.get("columns") or ([col] if col else []))
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    return names


def blank_columns(df: DataFrame) -> list[str]:
    """Columns without a single non-blank cell, found in one aggregate."""
    kinds = cells.kinds(df)
    if not kinds:
        return []
    row = df.agg(*[
        F.max(~cells.blank(c_(n), k)).alias(f"c{i}") for i, (n, k) in enumerate(kinds.items())
    ]).first()
    return [n for n, used in zip(kinds, row) if not used]


def _fit_blank_columns(df: DataFrame, col, params) -> dict:
    return {"columns": _named(df, col, params) or blank_columns(df)}


@step("drop_blank_columns", needs_column=False, fit=_fit_blank_columns)
def drop_blank_columns(df: DataFrame, col, params, fitted) -> Change:
    return Change(table=df.drop(*[c_(n) for n in fitted["columns"]]),
                  stats={"columns_dropped": fitted["columns"]})


@step("rename_columns", needs_column=False)
def rename_columns(df: DataFrame, col, params, fitted) -> Change:
    """Explicit mapping, or snake_case; names that collide get a number."""
    mapping = params.get("mapping") or {
        n: text.snake_case(n) or n for n in df.columns}
    names = text.distinct_names([mapping.get(n, n) for n in df.columns])
    n_new = sum(a != b for a, b in zip(df.columns, names))
    return Change(table=df.toDF(*names), stats={"columns_renamed": n_new})


def _needs_find(params: dict) -> None:
    if "find" not in params:
        raise ValueError("say what to replace: params.find is missing")
    if params.get("regex"):
        java_pattern(str(params["find"]))


@step("replace_values", check=_needs_find, writes=own_column)
def replace_values(df: DataFrame, col, params, fitted) -> Change:
    """Find and replace by whole cell, literal part or regex; nulls stay."""
    find, repl = str(params["find"]), str(params.get("replace", ""))
    case = bool(params.get("match_case", True))
    old = cells.as_text(df, col)
    if params.get("regex"):
        check_replacement(find, repl)
        new = F.regexp_replace(old, java_pattern(find, not case), java_replacement(repl))
    elif params.get("contains") and case:
        new = F.replace(old, F.lit(find), F.lit(repl))
    elif params.get("contains"):
        new = F.regexp_replace(old, java_literal(find, True), plain_replacement(repl))
    else:
        hit = old == find if case else F.lower(old) == find.lower()
        new = F.when(hit, F.lit(repl)).otherwise(old)
    return Change(assign={col: new}, flags={"rows_affected": cells.changed(old, new)})


def _known_case(params: dict) -> None:
    if params.get("case", "title") not in text.CASES:
        raise ValueError(f"case must be one of {list(text.CASES)}")


@step("format_text", check=_known_case, asked_only=lambda params: True, writes=own_column)
def format_text(df: DataFrame, col, params, fitted) -> Change:
    case = params.get("case", "title")
    old = cells.as_text(df, col)
    new = text.CASES[case](old)
    return Change(assign={col: new}, stats={"case": case},
                  flags={"rows_affected": cells.changed(old, new)})


@step("trim_whitespace", writes=own_column)
def trim_whitespace(df: DataFrame, col, params, fitted) -> Change:
    """One blank between words, none outside, composed Unicode (NFC)."""
    old = cells.as_text(df, col)
    new = text.nfc(cells.collapse_spaces(old))
    return Change(assign={col: new}, flags={"rows_affected": cells.changed(old, new)})


def _fit_round(df: DataFrame, col, params) -> dict:
    if df.filter(cells.as_number(df, col).isNotNull()).isEmpty():
        raise ValueError(f"no number to round in '{col}'")
    return {}


@step("round_numbers", fit=_fit_round, asked_only=lambda params: True, writes=own_column)
def round_numbers(df: DataFrame, col, params, fitted) -> Change:
    """Half-even rounding; text cells that are not numbers stay."""
    decimals = int(params.get("decimals", 2))
    old, number = c_(col), cells.as_number(df, col)
    if cells.kind(df, col) == "number":
        rounded = F.bround(old, decimals)
        new = rounded.cast(df.schema[col].dataType)
        hit = rounded != old
    else:
        rounded = F.bround(number, decimals)
        hit = rounded != number
        new = F.coalesce(cells.number_text(rounded, T.DoubleType()), old)
    return Change(assign={col: new}, stats={"decimals": decimals},
                  flags={"rows_affected": hit})


def _scale_method(params: dict) -> None:
    if params.get("method", "minmax") not in ("minmax", "zscore"):
        raise ValueError("method must be minmax or zscore")


def _scale_limits(col: str, params: dict, fitted: dict) -> dict:
    if fitted["n"] < 2:
        raise ValueError(f"scaling '{col}' takes two numbers or more")
    if fitted["min"] == fitted["max"]:
        raise ValueError(f"all numbers in '{col}' are equal, so they have no scale")
    return fitted


@step("scale_numeric", needs=lambda params: Need(moments=True), answer=_scale_limits,
      check=_scale_method, asked_only=lambda params: True, writes=own_column)
def scale_numeric(df: DataFrame, col, params, fitted) -> Change:
    """To 0..1 or to standard scores; the constants stay in the audit."""
    method = params.get("method", "minmax")
    x = cells.finite(cells.as_number(df, col))
    if method == "minmax":
        zero, unit = fitted["min"], fitted["max"] - fitted["min"]
        stats = {"min": fitted["min"], "max": fitted["max"]}
    else:
        zero, unit = fitted["mean"], fitted["std"]
        stats = {"mean": round(zero, 6), "std": round(unit, 6)}
    return Change(assign={col: (x - F.lit(zero)) / F.lit(unit)},
                  flags={"rows_affected": x.isNotNull()},
                  stats={"method": method, **stats})
