"""Labelled errors for a clean table, and the manifest that says where.

Which cells are hit is a function of the key, so the dirty table and its
manifest can be computed again anywhere and always agree.  The key column is
never touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.cells import col as c_
from ..functions.text import title_case

# --- fixed values -----------------------------------------------------------
ERROR_TYPES = {
    "dates": "mixed_date_format",
    "phones": "phone_format",
    "outliers": "outlier",
    "currency": "currency_format",
    "casing": "category_casing",
    "dtype": "dtype_corruption",
    "whitespace": "whitespace",
    "nulls": "null",
    "duplicates": "duplicate",
}
DATE_STYLES = ["MM/dd/yyyy", "MMMM dd, yyyy", "yyyyMMdd", "yyyy/MM/dd"]
MIN_ERRORS = 3
# --- end of fixed values ----------------------------------------------------
_BUCKETS = 1 << 40


class HashPick:
    """About ``rate`` of the cells, by a hash of key, column and seed; at
    least ``least``, by letting in the smallest hashes of a small table (0
    keeps the rate at every size)."""

    def __init__(self, rate: float = 0.10, seed: int = 42, least: int = MIN_ERRORS):
        self.rate, self.seed, self.least = rate, seed, least

    def _bucket(self, key: str, col: str, kind: str) -> Column:
        return F.pmod(F.xxhash64(c_(key).cast("string"), F.lit(f"{kind}/{col}/{self.seed}")),
                      F.lit(_BUCKETS))

    def limit(self, df: DataFrame, key: str, col: str, kind: str) -> int:
        low = (df.filter(c_(col).isNotNull()).select(self._bucket(key, col, kind).alias("b"))
               .orderBy("b").limit(self.least).agg(F.max("b")).first()[0])
        return max(int(self.rate * _BUCKETS), (low or 0) + 1)

    def hit(self, key: str, col: str, kind: str, limit: int) -> Column:
        return self._bucket(key, col, kind) < limit

    def choice(self, key: str, col: str, kind: str, n: int) -> Column:
        return F.pmod(F.shiftright(self._bucket(key, col, kind), 8), F.lit(n))


class KeyPick:
    """Every ``every``-th key, shifted per column; needs a whole-number key.
    Two engines that can do arithmetic pick the same cells."""

    def __init__(self, shifts: dict[tuple[str, str], int], every: int = 10):
        self.shifts, self.every = shifts, every

    def limit(self, df: DataFrame, key: str, col: str, kind: str) -> int:
        return self.shifts[kind, col]

    def hit(self, key: str, col: str, kind: str, limit: int) -> Column:
        return F.pmod(c_(key), F.lit(self.every)) == limit

    def choice(self, key: str, col: str, kind: str, n: int) -> Column:
        return F.pmod(F.floor(c_(key) / self.every), F.lit(n))


def _choose(index: Column, options: list[Column]) -> Column:
    out = F.when(index == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(index == i, option)
    return out


def _dates(df, col, i):
    c = c_(col)
    day = c.cast("date") if cells.kind(df, col) != "text" else F.try_to_date(c, "yyyy-MM-dd")
    iso = F.date_format(day, "yyyy-MM-dd") if cells.kind(df, col) != "text" else c
    return _choose(i, [F.date_format(day, s) for s in DATE_STYLES]), iso


def _phones(df, col, i):
    digits = F.regexp_replace(c_(col), r"^\+63", "")
    a, b, c = F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4)
    return _choose(i, [
        F.concat(F.lit("0"), digits),
        F.concat(F.lit("63-"), a, F.lit("-"), b, F.lit("-"), c),
        F.concat(F.lit("0"), a, F.lit(" "), b, F.lit(" "), c),
    ]), c_(col)


def _currency(df, col, i):
    x = c_(col).cast("double")
    grouped = F.format_number(x, 2)
    plain = F.translate(grouped, ",", "")
    return _choose(i, [F.concat(F.lit("₱"), grouped), F.concat(F.lit("PHP "), plain),
                       F.concat(F.lit("php "), grouped)]), cells.as_text(df, col)


def swap_case(c: Column) -> Column:
    lower = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, lower + lower.upper(), lower.upper() + lower)


def _casing(df, col, i):
    """The first style, from the chosen one on, that changes the cell."""
    c = c_(col)
    styles = [F.upper(c), F.lower(c), title_case(c), swap_case(c)]
    forms = F.filter(F.array(*styles), lambda f: f != c)
    place = F.pmod(i.cast("int"), F.greatest(F.size(forms), F.lit(1)))
    return F.get(forms, place), c


def _dtype(df, col, i):
    c, dtype = c_(col), df.schema[col].dataType
    if cells.kind(df, col) == "text":
        return F.concat(F.lit(" "), c, F.lit(" ")), c
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.format_number(c, 0), c.cast("string")
    text = cells.number_text(c, dtype)
    return F.concat(F.lit(" "), text, F.lit(" ")), text


def _outliers(df, col, i):
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.LongType):  # a number near the type's end stays as it is
        return F.coalesce(F.try_multiply(c_(col), F.lit(100)), c_(col)), c_(col)
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType)):
        return c_(col).cast("bigint") * 100, c_(col)  # the column widens
    return (c_(col) * 100).cast(dtype), c_(col)


def _whitespace(df, col, i):
    c = c_(col)
    return _choose(i, [
        F.concat(F.lit("  "), c), F.concat(c, F.lit("   ")),
        F.regexp_replace(c, "^([^ ]*) ", "$1  "), F.concat(F.lit("\t"), c, F.lit(" ")),
    ]), c


def _nulls(df, col, i):
    return F.lit(None), c_(col)


# Numbers are multiplied before they are written as text.
_MUTATORS = {"dates": _dates, "phones": _phones, "outliers": _outliers,
             "currency": _currency, "casing": _casing, "dtype": _dtype,
             "whitespace": _whitespace, "nulls": _nulls}
_STYLES = {"dates": 4, "phones": 3, "currency": 3, "casing": 4, "whitespace": 4}


@dataclass
class Injected:
    df: DataFrame
    manifest: DataFrame  # (type, col, key)


def inject(df: DataFrame, key: str, spec: dict[str, list[str]], pick=None) -> Injected:
    """Dirty copy of ``df`` and its manifest.

    ``spec`` names the columns per error kind (keys of ``ERROR_TYPES``);
    ``duplicates: [key]`` adds a copy of each picked row.  Both results are
    single lazy passes over the input.
    """
    pick = pick or HashPick()
    if any(key in cols for kind, cols in spec.items() if kind != "duplicates"):
        raise ValueError("the key column must stay clean")
    dirty, records = df, []
    hits: dict[str, Column] = {}
    for kind, mutate in _MUTATORS.items():
        for col in spec.get(kind, []):
            limit = pick.limit(df, key, col, kind)
            hit = pick.hit(key, col, kind, limit) & c_(col).isNotNull()
            choice = pick.choice(key, col, kind, _STYLES.get(kind, 1))
            new, old = mutate(dirty, col, choice)
            if kind == "casing":
                hit = hit & new.isNotNull()
            flag = f"_hit{len(hits)}"
            hits[flag] = hit
            dirty = dirty.withColumns({flag: hit, col: F.when(hit, new).otherwise(old)})
            records.append((flag, ERROR_TYPES[kind], col))
    twice = None
    if spec.get("duplicates"):
        limit = pick.limit(df, key, key, "duplicates")
        twice = pick.hit(key, key, "duplicates", limit) & c_(key).isNotNull()
        dirty = dirty.withColumn("_twice", twice)
        records.append(("_twice", ERROR_TYPES["duplicates"], key))
    errors = F.array_compact(F.array(*[
        F.when(F.col(flag), F.struct(F.lit(t).alias("type"), F.lit(c).alias("col")))
        for flag, t, c in records
    ]))
    manifest = dirty.select(c_(key).cast("string").alias("key"), F.explode(errors).alias("e"))
    helpers = [*hits, "_twice"]
    out = dirty
    if twice is not None:
        copies = F.when(F.col("_twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        out = dirty.withColumn("_copy", F.explode(copies)).drop("_copy")
    return Injected(out.drop(*helpers),
                    manifest.select("e.type", "e.col", "key"))
