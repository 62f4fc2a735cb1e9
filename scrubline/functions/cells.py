"""Cell-level expressions shared by every step, signal and rule.

Everything here is a plain built-in expression, so it stays inside whole-stage
code generation.  The one exception, Unicode normalisation, is in ``text.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

_SPACE = r"\s\x1c-\x1f"
# --- fixed values -----------------------------------------------------------
# Every character Python calls white space.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
          "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# --- end of fixed values ----------------------------------------------------
_FLOATS = (T.DoubleType, T.FloatType)


def col(name: str) -> Column:
    """A column by its literal name; dots and blanks need no care."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(dtype: T.DataType) -> str:
    """``text``, ``number``, ``bool`` or ``other`` (dates, arrays, structs...)."""
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def kind(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        raise ValueError(f"no column '{name}'")
    return kind_of(df.schema[name].dataType)


def is_one_of(df: DataFrame, name: str, values: list) -> Column:
    """The cell equals one of ``values`` of its own kind; values of another kind
    match no cell."""
    cell_kind = kind(df, name)
    fits = {"text": lambda v: isinstance(v, str), "bool": lambda v: isinstance(v, bool),
            "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)}
    typed = [v for v in values if fits.get(cell_kind, lambda v: True)(v)]
    return col(name).isin(typed) if typed else F.lit(False)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing cell; Spark's own null tests would not see it.

    The cell is named once, so that chained calls add up and do not double.
    """
    floats = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, _FLOATS)}
    return df.withColumns(
        {c: F.nanvl(col(c), F.lit(None).cast(t)) for c, t in floats.items()}
    ) if floats else df


def blank(c: Column, cell_kind: str = "text") -> Column:
    """Missing, or text made of white space only."""
    if cell_kind != "text":
        return c.isNull()
    return c.isNull() | (strip(c) == "")


def strip(c: Column) -> Column:
    """Without white space at the ends; looks at the outer bytes only."""
    return F.trim(c, F.lit(SPACES))


def collapse_spaces(c: Column) -> Column:
    """Every run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{P.U}[{_SPACE}]+", " "))


def has_double_space(c: Column) -> Column:
    return c.rlike(f"{P.U}[{_SPACE}]{{2,}}")


def fold(c: Column) -> Column:
    """Case- and margin-insensitive form used to group category variants."""
    return F.lower(strip(c))


def number_text(c: Column, dtype: T.DataType) -> Column:
    """A cell as the text a Python user would see.

    Spark writes large and small doubles in scientific notation; between 1e-4
    and 1e16 this gives the plain shortest form instead (``10000000.0``).
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if not isinstance(dtype, _FLOATS):
        return c.cast("string")
    size = F.abs(c)
    whole = F.concat(c.cast("bigint").cast("string"), F.lit(".0"))
    plain = F.rtrim(c.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    return (
        F.when((size < 1e15) & (c == F.floor(c)) & (c != 0), whole)
        .when((size >= 1e7) & (size < 1e16), plain)
        .when((size >= 1e-4) & (size < 1e-3), plain)
        .otherwise(c.cast("string"))
    )


def as_text(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    return col(name) if kind_of(dtype) == "text" else number_text(col(name), dtype)


def text_to_number(c: Column) -> Column:
    """Text to double; anything that is not wholly a number gives null.

    ``try_cast`` alone would accept Java spellings such as ``1d``.  The first
    character rules out most text before a pattern is tried.
    """
    s = strip(c)
    may_be = F.substring(s, 1, 1).isin(*"0123456789+-.iI")
    return F.when(may_be & s.rlike(P.PLAIN_NUMBER), s.try_cast("double"))


def grouped_text_to_number(c: Column) -> Column:
    """As :func:`text_to_number`, with thousands commas allowed."""
    return text_to_number(F.replace(c, F.lit(","), F.lit("")))


def as_number(df: DataFrame, name: str) -> Column:
    """A column as double; text that does not parse is null."""
    k = kind(df, name)
    if k == "text":
        return text_to_number(col(name))
    if k in ("number", "bool"):
        return col(name).cast("double")
    return F.lit(None).cast("double")


def finite(c: Column) -> Column:
    """The number, or null where it is infinite."""
    return F.when(F.abs(c) < float("inf"), c)


def changed(before: Column, after: Column) -> Column:
    """True where a cell differs; two missing cells do not differ."""
    return ~before.eqNullSafe(after)


#: Texts of more characters are grouped by their digest.
LONGEST_KEY = 128


def group_key(c: Column, longest: int = LONGEST_KEY) -> Column:
    """A text as grouping key: itself when short, its SHA-256 when long.

    Grouping whole documents would move every byte of them through the
    shuffle; 64 hex characters identify them as well.
    """
    return F.when(F.length(c) <= longest, F.concat(F.lit("="), c)).otherwise(
        F.concat(F.lit("#"), F.sha2(c, 256))
    )
