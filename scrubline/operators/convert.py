"""Steps that bring one column to a standard form or type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import patterns as P
from ..functions.cells import col as c_
from ..functions.dates import PIVOT_YEAR, with_date
from .base import Change, own_column, step


def _pivot(params: dict) -> None:
    pivot = params.get("pivot_year", PIVOT_YEAR)
    if pivot is not None and (isinstance(pivot, bool) or not isinstance(pivot, int) or not 1099 <= pivot <= 9999):
        raise ValueError("pivot_year is a year of four digits from 1099 on, or None")


@step("normalize_dates", check=_pivot, writes=own_column)
def normalize_dates(df: DataFrame, col, params, fitted) -> Change:
    """To ``yyyy-MM-dd`` text; cells that are no date stay as they are.

    ``as_date`` gives a date column instead, null where nothing fits.  Years of
    two digits end with ``pivot_year`` (2075: 76 is 1976); None leaves them alone.
    """
    base = with_date(df, cells.as_text(df, col), "_day", bool(params.get("dayfirst", False)),
                     params.get("pivot_year", PIVOT_YEAR))
    old, day = cells.as_text(df, col), F.col("_day")
    iso = F.coalesce(F.date_format(day, "yyyy-MM-dd"), old)
    return Change(assign={col: day if params.get("as_date") else iso},
                  base=base, helpers=["_day"],
                  flags={"rows_affected": cells.changed(old, iso),
                         "parse_failures": old.isNotNull() & day.isNull()})


def e164(c: Column) -> Column:
    """Philippine mobile number as ``+639XXXXXXXXX``, null if it is none."""
    digits = F.regexp_replace(c, r"(?U)\D", "")
    n = F.length(digits)
    return (F.when(digits.startswith("09") & (n == 11),
                   F.concat(F.lit("+63"), F.substring(digits, 2, 10)))
            .when(digits.startswith("639") & (n == 12), F.concat(F.lit("+"), digits))
            .when(digits.startswith("9") & (n == 10), F.concat(F.lit("+63"), digits)))


@step("normalize_phone", writes=own_column)
def normalize_phone(df: DataFrame, col, params, fitted) -> Change:
    old = cells.as_text(df, col)
    phone = e164(old)
    return Change(assign={col: F.coalesce(phone, old)},
                  flags={"rows_affected": phone != old,
                         "parse_failures": old.isNotNull() & phone.isNull()})


@step("normalize_currency", writes=lambda col, params: {col, f"{col}_currency", f"{col}_raw"})
def normalize_currency(df: DataFrame, col, params, fitted) -> Change:
    """Amount as double plus ``<col>_currency``; other cells become null.

    ``keep_raw`` keeps the original text in ``<col>_raw``.
    """
    old = cells.as_text(df, col)
    s = cells.strip(old)
    amount = F.translate(F.regexp_extract(s, P.CURRENCY_PARTS, 2), ",", "").try_cast("double")
    sign = F.regexp_extract(s, P.CURRENCY_PARTS, 1)
    code = (F.when(sign == "$", "USD").when(sign.isin("₱", ""), "PHP")
            .otherwise(F.upper(sign)))
    fits = s.rlike(P.CURRENCY_PARTS)
    assign = {col: F.when(fits, amount), f"{col}_currency": F.when(fits, code)}
    if params.get("keep_raw"):
        assign[f"{col}_raw"] = old
    return Change(assign=assign,
                  flags={"rows_affected": fits, "parse_failures": old.isNotNull() & ~fits})


def truth(c: Column) -> Column:
    word = cells.fold(c)
    return F.when(word.isin(P.TRUE_WORDS), True).when(word.isin(P.FALSE_WORDS), False)


def _target(params: dict) -> None:
    if params.get("target", "numeric") not in ("numeric", "bool"):
        raise ValueError("target must be numeric or bool")


@step("fix_dtypes", check=_target, writes=own_column)
def fix_dtypes(df: DataFrame, col, params, fitted) -> Change:
    """Text to numbers (thousands commas allowed) or to booleans; cells that
    do not convert become null and are counted."""
    if params.get("target", "numeric") == "numeric":
        is_text = cells.kind(df, col) == "text"
        new = cells.grouped_text_to_number(c_(col)) if is_text else c_(col)
    else:
        new = truth(cells.as_text(df, col))
        if params.get("as_int"):
            new = new.cast("int")
    return Change(assign={col: new},
                  flags={"rows_affected": new.isNotNull(),
                         "coercion_failures": c_(col).isNotNull() & new.isNull()})
