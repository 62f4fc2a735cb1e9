"""Casing, Unicode normal form and the column-name rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LETTERS = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]+"


def non_ascii(c: Column) -> Column:
    """More bytes than characters; no text is decoded to see that."""
    return F.octet_length(c) != F.length(c)


def nfc(c: Column) -> Column:
    """Canonical composition.  ASCII text is already in that form, so only the
    rest is sent to the Arrow worker; other rows travel as nulls."""
    @F.pandas_udf(T.StringType())
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.coalesce(compose(F.when(non_ascii(c), c)), c)


def rewrite_matches(c: Column, pattern: str, replace) -> Column:
    """Replace each match of ``pattern`` by ``replace(match)``, a Column
    function: the text is cut at the matches and sewn together again."""
    def rewritten(x: Column) -> Column:
        gaps = F.split(x, pattern, -1)
        hits = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), replace)
        pairs = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
        return F.when(x.rlike(pattern), F.array_join(pairs, "")).otherwise(x)

    # Bound to a lambda variable, ``c`` is computed once however often it is used.
    return F.get(F.transform(F.array(c), rewritten), F.lit(0))


def title_case(c: Column) -> Column:
    """A capital after every non-letter (``O'Neil Mary-Jane 3Rd``)."""
    return rewrite_matches(c, _LETTERS, F.initcap)


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)),
                    F.lower(F.substring(c, 2, 2147483647)))


CASES = {"upper": F.upper, "lower": F.lower,
         "title": title_case, "sentence": sentence_case}


def snake_case(name: str) -> str:
    """``Full Name`` and ``fullName`` -> ``full_name``."""
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return "_".join(w for w in re.split(r"[\W_]+", words) if w).lower()


def distinct_names(names: list[str]) -> list[str]:
    """Repeated names get a running number: ``a, a`` -> ``a, a_2``.  Names are
    compared without case, as Spark compares columns: ``id, ID`` -> ``id, ID_2``."""
    taken: set[str] = {name.casefold() for name in names}
    count: dict[str, int] = {}
    out: list[str] = []
    for name in names:
        key = name.casefold()
        count[key] = count.get(key, 0) + 1
        fresh = name
        if count[key] > 1:
            fresh = f"{name}_{count[key]}"
            while fresh.casefold() in taken:
                count[key] += 1
                fresh = f"{name}_{count[key]}"
            taken.add(fresh.casefold())
        out.append(fresh)
    return out
