"""Masking of personal data inside cells."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import rewrite_matches

_EMAIL_PARTS = r"([\w.+-])[\w.+-]*@([\w-])[\w-]*(?:\.[\w-]+)*\.([\w-]+)"
_PHONE_PARTS = (r"(?:\+?(63)[\s.-]?9|(0)[\s.-]?(9))"
                r"\d{2}[\s.-]?\d{3}[\s.-]?(\d{4})")
# A run's first two digits are kept; \G walks on through the rest of the run.
_DIGIT_RUN = r"((?<!\d)\d\d(?=\d{5})|\G(?!^))\d"


def mask_email(c: Column) -> Column:
    """``juan.dc@gmail.com`` -> ``j***@g***.com``"""
    masked = F.regexp_replace(c, P.U + _EMAIL_PARTS, "$1***@$2***.$3")
    return F.when(F.contains(c, F.lit("@")), masked).otherwise(c)


def mask_phone(c: Column) -> Column:
    """First two digits and the last four stay: ``09**-***-4567``"""
    return F.regexp_replace(c, P.U + _PHONE_PARTS, "$1$2$3**-***-$4")


def mask_long_digits(c: Column) -> Column:
    """Runs of seven digits or more keep their first two."""
    return F.regexp_replace(c, _DIGIT_RUN, "$1*")


def _initials(match: Column) -> Column:
    words = F.split(match, P.U + r"\s+")
    return F.array_join(
        F.transform(words, lambda w: F.rpad(F.substring(w, 1, 1), F.length(w), F.lit("*"))),
        " ",
    )


def mask_names(c: Column) -> Column:
    """``Juan Dela Cruz`` -> ``J*** D*** C***``"""
    return rewrite_matches(c, P.U + P.PERSON_NAME, _initials)


def mask_all(c: Column) -> Column:
    """All four masks; e-mail first because addresses can hold digits."""
    return mask_names(mask_long_digits(mask_phone(mask_email(c))))


def mask_whole(c: Column) -> Column:
    """Only the outer characters stay, with at most eight stars between."""
    n = F.length(c)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(
            F.substring(c, 1, 1),
            F.repeat(F.lit("*"), F.least(n - 2, F.lit(8))),
            F.substring(c, -1, 1),
        )
    )


def is_sensitive(column_name: str) -> bool:
    return re.search(P.SENSITIVE_COLUMN, column_name) is not None


def mask_sample(c: Column, column_name: str) -> Column:
    """A cell as it may be shown in a profile, an audit or a report."""
    return mask_whole(c) if is_sensitive(column_name) else mask_all(c)
