"""Reading dates that arrive in many spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import collapse_spaces

_CLOCK = (
    r"[T ]\s*(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d+)?)?"
    r"(?: ?[AaPp][Mm])?(?: ?(?:Z|[+-]\d{2}:?\d{2}))?$"
)
_WEEKDAY = r"(?i)^(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?:[.,] ?| )"
_SHORT_YEAR = (r"^\d{1,2}([/.-])\d{1,2}\1\d{2}$|"
               r"^(?:[A-Za-z]{3,}[ -]\d{1,2}(?:st|nd|rd|th)?|\d{1,2}(?:st|nd|rd|th)?[ -][A-Za-z]{3,}),?[ -]\d{2}$")
#: The last year that two digits can mean, unless told otherwise.
PIVOT_YEAR = 2075
# Year-first spellings are unambiguous and never swap day and month.
_YEAR_FIRST = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
]
_MONTH_NAMED = [
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
]
_YEAR_LAST = [("/", r"^\d{1,2}/\d{1,2}/\d{4}$"),
              ("-", r"^\d{1,2}-\d{1,2}-\d{4}$"),
              (".", r"^\d{1,2}\.\d{1,2}\.\d{4}$")]


def with_date(df: DataFrame, c: Column, out: str, dayfirst: bool = False,
              pivot_year: int | None = PIVOT_YEAR) -> DataFrame:
    """``df`` plus column ``out``: the text as ``date``, null when no known
    spelling fits.

    The shape of the text picks the one format to try, so a cell costs one
    parse and never a chain of failing ones.  A day/month pair that is
    impossible in the preferred order is read in the other order.  A weekday
    before the date is not looked at.  A year of two digits is the one of the
    hundred years up to ``pivot_year`` that ends in them; None reads no such year.
    The tidied text is a column of its own because every test below looks at it.
    """
    tidy, spelled = f"{out}_tidy", f"{out}_words"
    s, words = F.col(tidy), F.col(spelled)
    return (
        df.withColumn(tidy, F.regexp_replace(F.regexp_replace(collapse_spaces(c), _CLOCK, ""), _WEEKDAY, ""))
        .withColumn(tidy, s if pivot_year is None else F.when(s.rlike(_SHORT_YEAR), _long_year(s, pivot_year)).otherwise(s))
        .withColumn(spelled, F.when(s.rlike("[A-Za-z]"), _month_words(s)))
        .withColumn(out, _parse(s, words, dayfirst))
        .drop(tidy, spelled)
    )


def _long_year(s: Column, pivot: int) -> Column:
    year = F.lit(pivot) - F.pmod(F.lit(pivot) - F.right(s, F.lit(2)).cast("int"), F.lit(100))
    return F.concat(s.substr(F.lit(1), F.length(s) - 2), year.cast("string"))


def _month_words(s: Column) -> Column:
    words = F.regexp_replace(s, r"(?<=\d)(?:st|nd|rd|th)\b|[,.]", "")
    words = F.regexp_replace(words, r"(?i)\bsept\b", "Sep")
    return F.regexp_replace(words, r"(?<=[A-Za-z])-|-(?=[A-Za-z])", " ")


def _parse(s: Column, words: Column, dayfirst: bool) -> Column:
    first, second = "M{0}d{0}yyyy", "d{0}M{0}yyyy"
    if dayfirst:
        first, second = second, first
    out = None
    for shape, fmt in _YEAR_FIRST:
        hit, day = s.rlike(shape), F.try_to_date(s, fmt)
        out = F.when(hit, day) if out is None else out.when(hit, day)
    for sep, shape in _YEAR_LAST:
        out = out.when(s.rlike(shape), F.coalesce(F.try_to_date(s, first.format(sep)),
                                                  F.try_to_date(s, second.format(sep))))
    for shape, fmt in _MONTH_NAMED:
        out = out.when(words.rlike(shape), F.try_to_date(words, fmt))
    return out
